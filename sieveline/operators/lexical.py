"""BM25 over postings tables, and the tree of scoring queries."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.errors import InvalidQuery
from sieveline.functions.analysis import analyze, analyze_text
from sieveline.operators.filters import Filter, resolve
from sieveline.operators.scan import K1, B, best_documents, frequencies, slabs_by_document, slabs_of, token_slabs
from sieveline.operators.schema import Schema
from sieveline.storage import BROADCAST_ROWS, attach, is_small, materialise, spread

POSTINGS = "term string, doc_id long, tf long, length int, positions array<int>"
#: Documents whose tokens are counted at once.
DOCS_AT_ONCE = 2_000


def norm_length(length: Column) -> Column:
    """The length as a posting stores it: exact below 40, then the three bits after the leading one, offset by 24."""
    over = (length - 24).cast("long")
    shift = F.greatest(F.length(F.bin(over)) - 4, F.lit(0)).cast("int")
    cut = F.call_function("shiftleft", F.call_function("shiftright", over, shift), shift) + 24
    return F.when(length < 40, length.cast("long")).otherwise(cut)


def norm_length_of(length: int) -> int:
    if length < 40:
        return length
    over = length - 24
    shift = max(over.bit_length() - 4, 0)
    return (over >> shift << shift) + 24


def idf(docs: Column, df: Column) -> Column:
    return F.log1p((docs - df + 0.5) / (df + 0.5))


def bm25(tf: Column, weight: Column, length: Column, average: Column) -> Column:
    return weight * tf / (tf + K1 * (1 - B + B * length / average))


def top_k(scores: DataFrame, k: int, by: Sequence[str] = ("query_id",), digits: int = 12) -> DataFrame:
    """The k best of each query with `rank`: higher score, then smaller doc_id. Scores are rounded before they rank."""
    rounded = scores.withColumn("score", F.round("score", digits))
    order = [F.desc("score"), F.asc("doc_id")]
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order))
    if not by:
        rounded = rounded.orderBy(*order).limit(k)
    return rounded.withColumn("rank", rank).where(F.col("rank") <= k)


# the query tree


class LexicalQuery:
    pass


@dataclass(frozen=True)
class Match(LexicalQuery):
    """Terms of the text, OR-ed; a term that is there twice counts twice. field None: every indexed text field."""

    field: str | None
    text: str


@dataclass(frozen=True)
class Phrase(LexicalQuery):
    field: str
    text: str
    slop: int = 0


@dataclass(frozen=True)
class Term(LexicalQuery):
    """One term as it is, of a text or keyword field."""

    field: str
    term: str


@dataclass(frozen=True)
class Fuzzy(LexicalQuery):
    field: str
    term: str
    distance: int = 1


@dataclass(frozen=True)
class Bool(LexicalQuery):
    must: Sequence[LexicalQuery] = ()
    should: Sequence[LexicalQuery] = ()
    must_not: Sequence[LexicalQuery] = ()


@dataclass(frozen=True)
class Boost(LexicalQuery):
    query: LexicalQuery
    factor: float


def own_fields(query: LexicalQuery, fields: Sequence[str]) -> LexicalQuery:
    """Every Match over all fields spelled out over these fields, so that a field added beside them stays out."""
    if isinstance(query, Match) and query.field is None:
        return Bool(should=[Match(f, query.text) for f in fields])
    if isinstance(query, Boost):
        return Boost(own_fields(query.query, fields), query.factor)
    if isinstance(query, Bool):
        return Bool(*[[own_fields(q, fields) for q in part] for part in (query.must, query.should, query.must_not)])
    return query


@dataclass
class LexicalIndex:
    """docs: doc_id and the fields of the schema. Everything else is derived, once, when first needed.

    N and the average length count every document, also one without the field. With quantise the length in a score is
    rounded down as norm_length has it; the average is of exact lengths.
    """

    docs: DataFrame
    schema: Schema
    quantise: bool = True
    stored_postings: DataFrame | None = None
    extra: dict[str, DataFrame] = field(default_factory=dict)  # postings of fields beside the schema, such as a sparse one
    extra_boost: dict[str, float] = field(default_factory=dict)

    # tables

    def tokens(self, name: str) -> DataFrame:
        """(doc_id, tokens) of a text or keyword field, where the field is there."""
        f = self.schema[name]
        made = analyze(F.col(name), f.analyzer) if f.kind == "text" else F.array(F.col(name))
        return self._source.where(F.col(name).isNotNull()).select("doc_id", made.alias("tokens"))

    def field_postings(self, name: str, words: DataFrame | None = None) -> DataFrame:
        """(term, doc_id, tf, length) of a field; words: only these terms. Exact lengths, no positions."""
        if name in self.extra:
            rows = self.extra[name]
        elif self.stored_postings is not None:
            rows = self.stored_postings.where(F.col("field") == name).select("term", "doc_id", "tf", "length")
        else:
            said = self.tokens(name).select("doc_id", F.size("tokens").alias("length"), F.explode("tokens").alias("term"))
            if words is not None:
                said = said.join(F.broadcast(words) if is_small(words) else words, "term", "left_semi")
            # one exchange by document, which the documents of few files have behind them
            return (said if self._by_document else said.repartition("doc_id")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
        if words is not None:
            rows = rows.join(F.broadcast(words) if is_small(words) else words, "term", "left_semi")
        return rows

    def all_postings(self) -> DataFrame:
        """(field, term, doc_id, tf, length, positions) of every indexed text and keyword field: what an index stores.

        A document's tokens are counted where they arise, many documents at a time, so nothing is shuffled.
        """
        parts = []
        for f in self.schema.fields:
            if f.indexed and f.kind in ("text", "keyword"):
                parts.append(self.tokens(f.name).select(F.col("doc_id").cast("long").alias("doc_id"), "tokens").mapInArrow(_count_places, POSTINGS).select(F.lit(f.name).alias("field"), "*"))
        return reduce(DataFrame.unionByName, parts)

    @cached_property
    def constants(self) -> Constants:
        return Constants(self)

    @cached_property
    def _source(self) -> DataFrame:
        return spread(self.docs, "doc_id")

    @cached_property
    def _by_document(self) -> bool:
        return self._source is not self.docs

    # checks

    def _searchable(self, name: str, kinds: tuple[str, ...] = ("text",)) -> float:
        """The boost of a field; InvalidQuery if it can not be searched so."""
        if name in self.extra:
            return self.extra_boost.get(name, 1.0)
        f = self.schema[name]
        if not f.indexed or f.kind not in kinds:
            raise InvalidQuery(f"field {name!r} can not be searched this way")
        return f.boost

    def _score(self, name: str, boost: float, tf: str = "tf", weight: str = "weight") -> Column:
        _, average = self.constants[name]
        length = norm_length(F.col("length")) if self.quantise else F.col("length")
        return bm25(F.col(tf), F.col(weight), length, F.lit(average or 1.0)) * F.lit(float(boost))

    # batches of queries

    def query_terms(self, queries: DataFrame, name: str) -> DataFrame:
        """(query_id, term, qtf) of (query_id, text)."""
        analyzer = self.schema[name].analyzer
        said = queries.select("query_id", F.explode(analyze(F.col("text"), analyzer)).alias("term"))
        return said.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))

    def term_scores(self, terms: DataFrame, name: str, boost: float | None = None) -> DataFrame:
        """(query_id, doc_id, score) summed over (query_id, term, qtf) in one field."""
        return self.field_scores({name: terms}, None if boost is None else {name: boost})

    def field_scores(self, terms: dict[str, DataFrame], boosts: dict[str, float] | None = None, allowed: DataFrame | None = None) -> DataFrame:
        """(query_id, doc_id, score) summed over (query_id, term, qtf) in each of several fields.

        Only postings of these terms are made or read. They are exchanged by document once, while they are few;
        scores of a document are then summed, and cut by a later top k, where they arise. allowed: only these doc_ids
        get scores; the statistics are those of all documents, so postings are filtered once they are counted.
        Many terms meet the postings by a join that salts them: no task gets all postings of a frequent word.
        """
        boosts = {n: self._searchable(n, ("text", "keyword")) if boosts is None else boosts[n] for n in terms}
        self.constants.fill(terms)
        asked = materialise(reduce(DataFrame.unionByName, [t.select("query_id", F.lit(n).alias("field"), "term", F.col("qtf").cast("double").alias("qtf")) for n, t in terms.items()]), "query-terms")
        parts = [self.field_postings(n, asked.where(F.col("field") == n).select("term").distinct()).select(F.lit(n).alias("field"), "term", "doc_id", "tf", "length") for n in terms]
        postings = materialise(reduce(DataFrame.unionByName, parts), "postings")
        stats = postings.groupBy("field", "term").agg(F.count("*").alias("df"))

        def of_field(values: dict[str, float]) -> Column:
            return reduce(lambda rest, n: F.when(F.col("field") == n, F.lit(float(values[n]))).otherwise(rest), values, F.lit(0.0))

        total = next(iter(self.constants[n][0] for n in terms))
        weight = idf(F.lit(total), F.col("df")) * (1 + K1) * of_field(boosts) * F.col("qtf")
        wanted = asked.join(stats, ["field", "term"]).select("field", "term", "query_id", weight.alias("weight"))
        # what does not depend on the query is worked out once for each posting, before it meets its queries
        length = norm_length(F.col("length")) if self.quantise else F.col("length")
        average = of_field({n: self.constants[n][1] or 1.0 for n in terms})
        postings = postings.select("field", "term", "doc_id", bm25(F.col("tf"), F.lit(1.0), length, average).alias("part"))
        if allowed is not None:
            postings = postings.join(F.broadcast(allowed) if is_small(allowed) else allowed, "doc_id", "left_semi")
        if is_small(asked):
            # a fixed number of parts: by their bytes they look few, but each posting meets many queries
            parts_ = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            met = postings.repartition(parts_, "doc_id").join(F.broadcast(wanted), ["field", "term"])
        else:
            met = attach(postings, materialise(wanted, "wanted-terms"), ["field", "term"])
        scored = met.select("query_id", "doc_id", (F.col("weight") * F.col("part")).alias("score"))
        return scored.groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))

    def match_batch(self, queries: DataFrame, fields: Sequence[str] | None = None, allowed: DataFrame | None = None) -> DataFrame:
        """(query_id, doc_id, score) of every document that has a term of the query in one of the fields (all text fields)."""
        names = [f.name for f in self.schema.text_fields] if fields is None else list(fields)
        for n in names:
            self._searchable(n)
        return self.field_scores({n: self.query_terms(queries, n) for n in names}, allowed=allowed)

    def search_batch(self, queries: DataFrame, k: int, fields: Sequence[str] | None = None, condition: Filter | None = None, digits: int = 12) -> DataFrame:
        """The k best of each query. A filter takes candidates away; scores stay those of the whole corpus."""
        names = [f.name for f in self.schema.text_fields] if fields is None else list(fields)
        for n in names:
            self._searchable(n)
        return self.best({n: self.query_terms(queries, n) for n in names}, k, condition=condition, digits=digits)

    def best(self, terms: dict[str, DataFrame], k: int, boosts: dict[str, float] | None = None, allowed: DataFrame | None = None, condition: Filter | None = None, digits: int = 12) -> DataFrame:
        """(query_id, doc_id, score, rank): the k best of field_scores, without a row for each pair of query and document.

        Documents are packed with the postings of the queries' terms, many in one row; such slabs and the queries meet in
        a grid of tasks, each of which returns k documents for each of its queries. Fields of texts are counted where the
        texts are read, and N and the lengths with them; stored postings are exchanged by document first.
        condition, allowed: documents that may be answers; the statistics are those of all.
        """
        boosts = {n: self._searchable(n, ("text", "keyword")) if boosts is None else boosts[n] for n in terms}
        numbers = {n: i for i, n in enumerate(terms)}
        said = [t.select("query_id", F.concat(F.lit(f"{i}:"), "term").alias("key"), F.lit(float(boosts[n])).alias("boost"), F.col("qtf").cast("double").alias("qtf")) for (n, t), i in zip(terms.items(), numbers.values())]
        asked = materialise(reduce(DataFrame.unionByName, said), "query-terms")
        if self.stored_postings is None and not any(n in self.extra for n in terms):
            slabs = self._token_slabs(terms, asked, allowed, condition)
        else:
            slabs = self._posting_slabs(terms, asked, allowed, condition)
        total = next(iter(self.constants[n][0] for n in terms))
        weight = idf(F.lit(total), F.col("df")) * (1 + K1) * F.col("boost") * F.col("qtf")
        wanted = asked.join(frequencies(slabs), "key").select("query_id", "key", weight.alias("weight"))
        return best_documents(wanted, slabs, k, digits, {i: self.constants[n][1] or 1.0 for n, i in numbers.items()}, self.quantise)

    def _token_slabs(self, terms: Iterable[str], asked: DataFrame, allowed: DataFrame | None, condition: Filter | None) -> DataFrame:
        words: list[list[str] | None] = [None for _ in terms]
        keys = [r["key"].split(":", 1) for r in asked.select("key").distinct().limit(BROADCAST_ROWS + 1).collect()]
        if len(keys) <= BROADCAST_ROWS:  # else every term is packed
            words = [[t for f, t in keys if f == str(i)] for i, _ in enumerate(terms)]
        docs, kept = self._source, F.lit(True)
        if condition is not None:
            kept = condition.column(self.schema)
        if allowed is not None:
            mark = allowed.select("doc_id", F.lit(True).alias("__allowed"))
            docs = docs.join(F.broadcast(mark) if is_small(allowed) else mark, "doc_id", "left")
            kept = kept & F.col("__allowed").isNotNull()

        def tokens(name: str) -> Column:
            f = self.schema[name]
            made = analyze(F.col(name), f.analyzer) if f.kind == "text" else F.array(F.col(name))
            return F.when(F.col(name).isNotNull(), made).alias(f"__{name}")

        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(kept, F.lit(False)).alias("__kept"), *[tokens(n) for n in terms])
        slabs = slabs_of(rows, token_slabs, "slabs", words=words)
        if any(n not in self.constants for n in terms):
            row = slabs.agg(F.sum("docs"), *[F.sum(F.col("sums")[i]) for i, _ in enumerate(terms)]).first()
            for i, n in enumerate(terms):
                self.constants[n] = (row[0] or 0, row[1 + i] / row[0] if row[0] else 0.0)
        return slabs

    def _posting_slabs(self, terms: Iterable[str], asked: DataFrame, allowed: DataFrame | None, condition: Filter | None) -> DataFrame:
        self.constants.fill(terms)
        words = asked.select("key").distinct().withColumn("field", F.substring_index("key", ":", 1)).withColumn("term", F.expr("substr(key, instr(key, ':') + 1)"))
        parts = [self.field_postings(n, words.where(F.col("field") == str(i)).select("term")).select("doc_id", F.concat(F.lit(f"{i}:"), "term").alias("key"), "tf", "length") for i, n in enumerate(terms)]
        rows = reduce(DataFrame.unionByName, parts).withColumn("__kept", F.lit(True))
        if condition is not None:
            chosen = materialise(resolve(self.docs, self.schema, condition), "allowed")
            allowed = chosen if allowed is None else chosen.join(allowed, "doc_id", "left_semi")
        if allowed is not None:
            mark = allowed.select("doc_id", F.lit(True).alias("__allowed"))
            rows = rows.join(F.broadcast(mark) if is_small(allowed) else mark, "doc_id", "left").withColumn("__kept", F.col("__allowed").isNotNull())
        rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "__kept", "key", "tf", F.col("length").cast("int").alias("length"))
        return slabs_by_document(rows, self.constants[next(iter(terms))][0])

    # one query tree

    def compile(self, query: LexicalQuery) -> DataFrame:
        """(doc_id, score) of the documents a query tree matches. Postings of all its terms are made or read once."""
        wanted: dict[str, set[str]] = {}
        self._terms_of(query, wanted)
        if not wanted:
            return self._compile(query, None)
        self.constants.fill(wanted)
        spark = self.docs.sparkSession
        parts = [self.field_postings(n, spark.createDataFrame([(t,) for t in sorted(ts)], "term string")).select(F.lit(n).alias("field"), "term", "doc_id", "tf", "length") for n, ts in wanted.items()]
        postings = materialise(reduce(DataFrame.unionByName, parts), "postings")
        df = {(r["field"], r["term"]): r["count"] for r in postings.groupBy("field", "term").count().collect()}  # a row per term of the tree
        return self._compile(query, (postings, df))

    def _terms_of(self, query: LexicalQuery, into: dict[str, set[str]]) -> None:
        if isinstance(query, Match):
            for n in [f.name for f in self.schema.text_fields] if query.field is None else [query.field]:
                self._searchable(n)
                if terms := set(analyze_text(query.text, self.schema[n].analyzer)):
                    into.setdefault(n, set()).update(terms)
        elif isinstance(query, Term):
            self._searchable(query.field, ("text", "keyword"))
            into.setdefault(query.field, set()).add(query.term)
        elif isinstance(query, Phrase):
            self._searchable(query.field)
            if len(terms := analyze_text(query.text, self.schema[query.field].analyzer)) == 1:
                into.setdefault(query.field, set()).update(terms)
        elif isinstance(query, Boost):
            self._terms_of(query.query, into)
        elif isinstance(query, Bool):
            for q in (*query.must, *query.should, *query.must_not):
                self._terms_of(q, into)

    def _compile(self, query: LexicalQuery, ready: tuple[DataFrame, dict] | None) -> DataFrame:
        if isinstance(query, Match):
            names = [f.name for f in self.schema.text_fields] if query.field is None else [query.field]
            parts = []
            for n in names:
                boost = self._searchable(n)
                if terms := Counter(analyze_text(query.text, self.schema[n].analyzer)):
                    parts.append(self._terms(n, terms, boost, ready))
            return _summed(parts) if parts else self._nothing()
        if isinstance(query, Term):
            return self._terms(query.field, {query.term: 1}, self._searchable(query.field, ("text", "keyword")), ready)
        if isinstance(query, Phrase):
            return self._phrase(query, ready)
        if isinstance(query, Fuzzy):
            return self._fuzzy(query)
        if isinstance(query, Boost):
            return self._compile(query.query, ready).select("doc_id", (F.col("score") * F.lit(float(query.factor))).alias("score"))
        if isinstance(query, Bool):
            return self._bool(query, ready)
        raise InvalidQuery(f"unknown query {query!r}")

    def search(self, query: LexicalQuery, k: int, condition: Filter | None = None, digits: int = 12) -> DataFrame:
        """(doc_id, score, rank) of the k best."""
        if k <= 0:
            return self._nothing().withColumn("rank", F.lit(0))
        scores = self.compile(query)
        if condition is not None:
            scores = scores.join(resolve(self.docs, self.schema, condition), "doc_id", "left_semi")
        return top_k(scores, k, by=(), digits=digits)

    def _nothing(self) -> DataFrame:
        return self.docs.sparkSession.createDataFrame([], "doc_id long, score double")

    def _terms(self, name: str, terms: dict[str, float], boost: float, ready: tuple[DataFrame, dict]) -> DataFrame:
        """Summed scores of terms with how often each is asked for."""
        postings, df = ready
        known = {t: n for t, n in terms.items() if (name, t) in df}
        if not known:
            return self._nothing()
        total, _ = self.constants[name]
        weight = reduce(lambda rest, t: F.when(F.col("term") == t, idf(F.lit(total), F.lit(df[name, t])) * (1 + K1) * float(known[t])).otherwise(rest), known, F.lit(0.0))
        rows = postings.where((F.col("field") == name) & F.col("term").isin(list(known))).withColumn("weight", weight)
        scored = rows.select("doc_id", self._score(name, boost).alias("score"))
        return scored.groupBy("doc_id").agg(F.sum("score").alias("score")) if len(known) > 1 else scored

    def _phrase(self, query: Phrase, ready: tuple[DataFrame, dict] | None) -> DataFrame:
        boost = self._searchable(query.field)
        terms = analyze_text(query.text, self.schema[query.field].analyzer)
        if query.slop < 0:
            raise InvalidQuery("slop is not negative")
        if not terms:
            return self._nothing()
        if len(terms) == 1:
            return self._terms(query.field, {terms[0]: 1}, boost, ready)
        names = sorted(set(terms))
        docs = materialise(self._places(query.field, names), "phrase")
        total, _ = self.constants[query.field]
        freqs = docs.agg(*[F.count(F.when(F.size(f"p{i}") > 0, 1)) for i in range(len(names))]).first()
        if any(f == 0 for f in freqs):
            return self._nothing()
        weight = reduce(lambda a, b: a + b, [idf(F.lit(total), F.lit(freqs[names.index(t)])) for t in terms]) * (1 + K1)
        full = docs.where(reduce(lambda a, b: a & b, [F.size(f"p{i}") > 0 for i in range(len(names))]))
        places = [F.col(f"p{names.index(t)}") for t in terms]
        count = _exact_phrases(places) if query.slop == 0 else _near_phrases(places, query.slop)
        found = full.select("doc_id", "length", count.alias("tf")).where("tf > 0").withColumn("weight", weight)
        return found.select("doc_id", self._score(query.field, boost).alias("score"))

    def _places(self, name: str, terms: Sequence[str]) -> DataFrame:
        """(doc_id, length, p0, p1, ...): where each term stands, of the documents that have one of them."""
        if self.stored_postings is not None:
            rows = self.stored_postings.where((F.col("field") == name) & F.col("term").isin(list(terms)))
            at = [F.coalesce(F.first(F.when(F.col("term") == t, F.col("positions")), ignorenulls=True), F.array().cast("array<int>")).alias(f"p{i}") for i, t in enumerate(terms)]
            return rows.groupBy("doc_id").agg(F.first("length").alias("length"), *at)
        said = self.tokens(name).where(F.arrays_overlap("tokens", F.array(*[F.lit(t) for t in terms])))
        at = [_where("tokens", t).alias(f"p{i}") for i, t in enumerate(terms)]
        return said.select("doc_id", F.size("tokens").alias("length"), *at)

    def _fuzzy(self, query: Fuzzy) -> DataFrame:
        boost = self._searchable(query.field, ("text", "keyword"))
        if not 0 <= query.distance <= 2:
            raise InvalidQuery("a fuzzy distance goes from 0 to 2")
        if self.stored_postings is not None:
            rows = self.stored_postings.where(F.col("field") == query.field)
            words = rows.select("term").distinct().where(F.levenshtein(F.col("term"), F.lit(query.term), query.distance) >= 0)
            return rows.join(words, "term", "left_semi").select("doc_id").distinct().select("doc_id", F.lit(float(boost)).alias("score"))
        tokens = self.tokens(query.field)
        hit = F.exists(F.array_distinct("tokens"), lambda t: F.levenshtein(t, F.lit(query.term), query.distance) >= 0)
        return tokens.where(hit).select("doc_id", F.lit(float(boost)).alias("score"))

    def _bool(self, query: Bool, ready: tuple[DataFrame, dict] | None) -> DataFrame:
        must, should, must_not = ([self._compile(q, ready) for q in part] for part in (query.must, query.should, query.must_not))
        if not must and not should:
            return self._nothing()
        if must:
            rows = must[0]
            for i, m in enumerate(must[1:]):
                rows = rows.join(m.withColumnRenamed("score", f"m{i}"), "doc_id").select("doc_id", (F.col("score") + F.col(f"m{i}")).alias("score"))
            if should:
                more = _summed(should).withColumnRenamed("score", "more")
                rows = rows.join(more, "doc_id", "left").select("doc_id", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))
        else:
            rows = _summed(should)
        for n in must_not:
            rows = rows.join(n.select("doc_id"), "doc_id", "left_anti")
        return rows

    # statistics

    def term_stats(self, name: str, term: str) -> tuple[int, int] | None:
        """Documents of a term and its occurrences; None if no document has it."""
        self._searchable(name, ("text", "keyword"))
        words = self.docs.sparkSession.createDataFrame([(term,)], "term string")
        row = self.field_postings(name, words).agg(F.count("*"), F.sum("tf")).first()
        return (row[0], row[1]) if row[0] else None

    def stats(self) -> DataFrame:
        """(num_docs, field, avg_field_len): the average is over the documents that have the field."""
        parts = []
        for f in self.schema.text_fields:
            parts.append(self.docs.agg(F.count("*").alias("num_docs"), F.coalesce(F.avg(F.when(F.col(f.name).isNotNull(), F.size(analyze(F.col(f.name), "standard")))), F.lit(0.0)).alias("avg_field_len")).select("num_docs", F.lit(f.name).alias("field"), "avg_field_len"))
        return reduce(DataFrame.unionByName, parts)


class Constants(dict):
    """For each text and keyword field: documents in all, and average length over all of them; worked out when asked for."""

    def __init__(self, index: LexicalIndex):
        super().__init__()
        self.index = index

    def __missing__(self, name: str) -> tuple[int, float]:
        self.fill([name])
        return self[name]

    def fill(self, names: Iterable[str]) -> None:
        """Those of several fields in one pass. Stored frequencies add up to the lengths; else texts are analysed."""
        index, names = self.index, [n for n in names if n not in self]
        if not names:
            return
        fresh = [n for n in names if n not in index.extra and index.stored_postings is None]
        # the number of tokens does not depend on stemming
        size = {n: F.size(analyze(F.col(n), "standard")) if index.schema[n].kind == "text" else F.lit(1) for n in fresh}
        row = index._source.agg(F.count("*").alias("__n"), *[F.sum(F.when(F.col(n).isNotNull(), size[n])).alias(n) for n in fresh]).first()
        sums = {n: row[n] for n in fresh}
        for n in names:
            if n in index.extra:
                sums[n] = index.extra[n].agg(F.sum("tf")).first()[0]
        if stored := [n for n in names if n not in sums]:
            rows = index.stored_postings.where(F.col("field").isin(stored)).groupBy("field").agg(F.sum("tf").alias("tf")).collect()
            sums |= {n: 0 for n in stored} | {r["field"]: r["tf"] for r in rows}
        for n in names:
            self[n] = (row["__n"], (sums[n] or 0) / row["__n"] if row["__n"] else 0.0)


def _count_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """POSTINGS of (doc_id, tokens)."""
    for whole in batches:
        for first in range(0, whole.num_rows, DOCS_AT_ONCE):
            batch = whole.slice(first, DOCS_AT_ONCE)
            lengths = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = batch.column(1).flatten().dictionary_encode()
            if not len(coded):
                continue
            codes = coded.indices.to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(lengths)), lengths)
            place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            by = np.lexsort((place, codes, row))
            row, codes, place = row[by], codes[by], place[by]
            begins = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (codes[1:] != codes[:-1])])
            ends = np.r_[begins, len(codes)]
            yield pa.RecordBatch.from_arrays(
                [
                    coded.dictionary.take(pa.array(codes[begins])), batch.column(0).take(pa.array(row[begins])), pa.array(np.diff(ends).astype(np.int64)),
                    pa.array(lengths[row[begins]].astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(place.astype(np.int32))),
                ],
                names=["term", "doc_id", "tf", "length", "positions"],
            )


def _summed(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy("doc_id").agg(F.sum("score").alias("score")) if len(parts) > 1 else parts[0]


def _where(tokens: str, term: str) -> Column:
    """The places of a term in an array that is not empty."""
    return F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), lambda i: F.get(F.col(tokens), i) == F.lit(term))


def _exact_phrases(places: Sequence[Column]) -> Column:
    """How often the terms stand in a row."""
    rest = list(enumerate(places))[1:]
    return F.size(F.filter(places[0], lambda x: reduce(lambda a, b: a & b, [F.array_contains(p, x + j) for j, p in rest])))


def _near_phrases(places: Sequence[Column], slop: int) -> Column:
    """How often the terms stand near each other in order, give or take `slop` places.

    Places of each term are shifted by where it stands in the phrase, so that an exact phrase meets in one place. The
    places reached so far and those of the next term meet where they are `slop` apart at most. The next term's places are
    taken from left to right: one that has no partner within reach is left; else it is the new place reached, and
    its partners up to itself are used up, or the first one beyond where there is none up to itself.
    """
    reached = places[0]
    for j, other in enumerate(places[1:], 1):
        begin = F.struct(reached.alias("open"), F.array().cast("array<int>").alias("met"))
        shifted = F.transform(other, _less(j))
        reached = F.aggregate(shifted, begin, lambda state, at: _meet(state, at, slop))["met"]
    return F.size(reached)


def _less(by: int) -> Callable[[Column], Column]:
    return lambda x: x - by


def _meet(state: Column, at: Column, slop: int) -> Column:
    near = F.filter(state["open"], lambda x: x >= at - slop)
    first = F.get(near, F.lit(0))
    beyond = F.filter(near, lambda x: x > at)
    left = F.when(first > at, F.slice(near, 2, F.greatest(F.size(near), F.lit(1)))).otherwise(beyond)
    hit = F.coalesce(first <= at + slop, F.lit(False))
    return F.struct(F.when(hit, left).otherwise(near).alias("open"), F.when(hit, F.concat(state["met"], F.array(at))).otherwise(state["met"]).alias("met"))
