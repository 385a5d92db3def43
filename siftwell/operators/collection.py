"""A collection of documents and every retrieval operator over it.

Documents are rows (doc_id, leaves, tokens); predicates look inside a row, so they are narrow
scans without a join or a shuffle. What needs the whole corpus (vocabulary, document
frequencies, average length) is one aggregation with map-side combining.
"""

from __future__ import annotations

import datetime

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import stem
from siftwell.functions import text as X
from siftwell.operators import flatten


@dataclass(frozen=True)
class TokenizerConfig:
    """n-grams are off without a bound; a missing lower one is 1, a missing upper one the lower."""

    use_stemming: bool = False
    min_ngram: int | None = None
    max_ngram: int | None = None

    def __post_init__(self):
        if self.ngrams and (self.ngrams[0] < 1 or self.ngrams[0] > self.ngrams[1]):
            raise ValueError("n-gram lengths must be 1 <= min <= max")

    @property
    def ngrams(self) -> tuple[int, int] | None:
        if self.min_ngram is None and self.max_ngram is None:
            return None
        low = self.min_ngram if self.min_ngram is not None else 1
        return low, self.max_ngram if self.max_ngram is not None else low


DEFAULT = TokenizerConfig(min_ngram=2, max_ngram=5)


_NO_TOKENS = "array<string>"


def _every(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _some(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


class Collection:
    """Operators over documents.

    ``base`` has a row for each document: a unique doc_id, a column for each of ``plain`` (root fields
    known to the plan, whose predicates reach the scan), ``leaves`` (all that is nested or
    schemaless) and perhaps ``tokens``. Other columns are ignored.
    """

    def __init__(self, base: DataFrame, config: TokenizerConfig = DEFAULT, plain: Sequence[flatten.Field] = (), max_depth: int | None = None, nested: bool = True):
        self.config, self.plain, self.max_depth, self.nested = config, list(plain), max_depth, nested
        keep = ["doc_id", *[f.column for f in self.plain], "leaves"]
        self.tokenized = "tokens" in base.columns
        self.base = base.select(*keep, *(["tokens"] if self.tokenized else []))
        if not self.tokenized and config.use_stemming:
            self.base, self.tokenized = self.base.withColumn("tokens", stem.stems(self._tokens())), True

    @classmethod
    def from_table(cls, df: DataFrame, id_col: str, fields: list[str] | None = None, config: TokenizerConfig = DEFAULT, max_depth: int | None = None) -> Collection:
        base, plain = flatten.table_fields(df, id_col, fields, max_depth)
        n = len(fields) if fields is not None else len(df.columns) - 1
        return cls(base, config, plain, max_depth, nested=len(plain) < n)

    @classmethod
    def from_json(cls, df: DataFrame, id_col: str, json_col: str, config: TokenizerConfig = DEFAULT, max_depth: int | None = None, date_paths: tuple[str, ...] = ()) -> Collection:
        return cls(flatten.json_leaves(df, id_col, json_col, max_depth, date_paths), config)

    @classmethod
    def load(cls, spark: SparkSession, path: str, config: TokenizerConfig = DEFAULT) -> Collection:
        return cls(spark.read.parquet(path), config)

    def save(self, path: str) -> Collection:
        """The flattened, tokenized documents as a table; opened again by ``load``."""
        self.docs.write.mode("overwrite").parquet(path)
        return Collection.load(self.docs.sparkSession, path, self.config)

    def save_postings(self, path: str) -> DataFrame:
        """Postings in order of term, so that row groups are skipped in look-ups of single terms."""
        self.postings.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(path)
        return self.base.sparkSession.read.parquet(path)

    def _tokens(self) -> Column:
        none = F.array().cast(_NO_TOKENS)
        parts = [F.coalesce(X.tokens(f.searched), none) for f in self.plain]
        if self.nested:
            parts.append(F.flatten(F.transform("leaves", lambda x: F.coalesce(X.tokens(x["text"]), F.array().cast(_NO_TOKENS)))))
        return F.concat(*parts) if parts else none

    # --- derived tables

    @cached_property
    def docs(self) -> DataFrame:
        """(doc_id, leaves, tokens) of every document."""
        own = F.array_compact(F.array(*[f.as_leaf(self.max_depth != 0) for f in self.plain])) if self.plain else None
        leaves = F.col("leaves") if own is None else F.concat(own, "leaves") if self.nested else own
        return self.base.select("doc_id", leaves.alias("leaves"), (F.col("tokens") if self.tokenized else self._tokens()).alias("tokens"))

    @cached_property
    def fields(self) -> DataFrame:
        """A row for each leaf."""
        return self.docs.select("doc_id", F.explode_outer("leaves").alias("f")).select("doc_id", "f.*").where("path is not null")

    @cached_property
    def occurrences(self) -> DataFrame:
        """(doc_id, path, term) for each token."""
        if self.config.use_stemming:
            per_leaf = self.fields.select("doc_id", "path", stem.stems(X.tokens(F.col("text"))).alias("ts"))
            return per_leaf.select("doc_id", "path", F.explode("ts").alias("term"))
        # outer: else a filter on the array's size would tokenize once more below
        if len(self.plain) == 1 and not self.nested:
            f = self.plain[0]
            return self.base.select("doc_id", F.lit(f.path).alias("path"), F.explode_outer(X.tokens(f.searched)).alias("term")).where("term is not null")

        def of(path: Column, text: Column) -> Column:
            return F.transform(X.tokens(text), lambda t: F.struct(path.alias("path"), t.alias("term")))

        none = F.array().cast("array<struct<path:string,term:string>>")
        parts = [F.coalesce(of(F.lit(f.path), f.searched), none) for f in self.plain]
        if self.nested:
            parts.append(F.flatten(F.transform("leaves", lambda x: F.coalesce(of(x["path"], x["text"]), F.array().cast("array<struct<path:string,term:string>>")))))
        return self.base.select("doc_id", F.explode_outer(F.concat(*parts) if parts else none).alias("o")).select("doc_id", "o.path", "o.term").where("term is not null")

    @cached_property
    def postings(self) -> DataFrame:
        """(term, doc_id, tf, field_paths): one shuffle on (term, doc_id), combined on the map side."""
        return self.occurrences.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_set("path")).alias("field_paths"))

    @cached_property
    def doc_stats(self) -> DataFrame:
        """(doc_id, dl) of documents that have a token; narrow."""
        return self.docs.select("doc_id", F.size("tokens").cast("long").alias("dl")).where("dl > 0")

    @cached_property
    def vocab(self) -> DataFrame:
        """(term, df) over all documents."""
        return self.docs.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))

    @cached_property
    def grams(self) -> DataFrame:
        """(gram, term) for each n-gram of each term."""
        low, high = self.config.ngrams or (1, 0)
        if high < low:
            return self.vocab.select(F.lit("").alias("gram"), "term").limit(0)
        return self.vocab.select("term", F.explode(F.array_distinct(X.ngrams(F.col("term"), low, high))).alias("gram")).select("gram", "term")

    def stats(self) -> DataFrame:
        """One row: documents, distinct terms, postings, distinct paths, total and average tokens."""
        count = lambda ok: F.sum(ok.cast("long"))
        seen = [F.max(f.value.isNotNull().cast("long")).alias(f"has_{i}") for i, f in enumerate(self.plain)]
        rows = self.base.select("*", *([] if self.tokenized else [self._tokens().alias("tokens")]))
        d = rows.agg(F.count("*").alias("n_docs"), count(F.size("tokens") > 0).alias("n_with_text"), F.sum(F.size("tokens")).alias("n_tokens"), F.sum(F.size(F.array_distinct("tokens"))).alias("n_postings"), *seen)
        d = d.withColumn("avgdl", F.when(F.col("n_with_text") > 0, F.col("n_tokens") / F.col("n_with_text")))
        paths = reduce(lambda x, y: x + y, [F.coalesce(F.col(f"has_{i}"), F.lit(0)) for i in range(len(seen))], F.lit(0).cast("long"))
        d = d.crossJoin(self.vocab.agg(F.count("*").alias("n_terms")))
        if self.nested:
            d = d.crossJoin(self.base.select(F.explode("leaves.path").alias("path")).agg(F.count_distinct("path").alias("n_nested")))
            paths = paths + F.col("n_nested")
        return d.select("n_docs", "n_terms", "n_postings", paths.alias("n_paths"), "n_tokens", "n_with_text", "avgdl")

    # --- look-ups by word

    def _terms(self, words: Sequence[str]) -> list[str]:
        """Each word is one term, whole: it is lower-cased (and stemmed with stemming), not tokenized."""
        low = [w.lower() for w in words]
        return list(dict.fromkeys(stem.stem(w) if self.config.use_stemming else w for w in low))

    def has_any(self, words: Sequence[str]) -> Column:
        """Whether a row of ``base`` has any of the words."""
        terms = self._terms(words)
        if not terms:
            return F.lit(False)
        if self.tokenized:
            return F.arrays_overlap("tokens", F.array(*[F.lit(t) for t in terms]))
        numeric = any(t.isdigit() or t in ("nan", "inf") for t in terms)
        hits = [X.has_token(f.searched, terms) for f in self.plain if f.kind == "text" or numeric]
        if self.nested:
            hits.append(F.exists("leaves", lambda x: X.has_token(x["text"], terms)))
        return _some(hits)

    def get(self, doc_id: object) -> DataFrame:
        return self.base.where(F.col("doc_id") == F.lit(doc_id))

    def words(self, words: Sequence[str]) -> DataFrame:
        """Documents with any of the words."""
        return self.base.where(self.has_any(words)).select("doc_id")

    def and_words(self, words: Sequence[str]) -> DataFrame:
        """Documents with all of the words; none for no words."""
        every = _every(self.has_any([w]) for w in words) if words else F.lit(False)
        return self.base.where(every).select("doc_id")

    def not_words(self, words: Sequence[str]) -> DataFrame:
        """Documents with none of the words."""
        return self.base.where(~self.has_any(words)).select("doc_id")

    def doc_freq(self, word: str) -> DataFrame:
        return self.words([word]).agg(F.count("*").alias("df"))

    def get_postings(self, term: str) -> DataFrame:
        """(doc_id, tf, field_paths) of a term as it is written; narrow, as a document is one row."""
        if self.config.use_stemming:  # Python functions don't run inside lambdas
            return self.postings.where(F.col("term") == term).select("doc_id", "tf", "field_paths")
        tf = reduce(lambda x, y: x + y, [X.count_token(f.searched, term) for f in self.plain], F.lit(0))
        paths = F.array_compact(F.array(*[F.when(X.has_token(f.searched, [term]), F.lit(f.path)) for f in self.plain])).cast("array<string>")
        if self.nested:
            hit = F.filter("leaves", lambda x: X.has_token(x["text"], [term]))
            tf = tf + F.aggregate(hit, F.lit(0), lambda n, x: n + X.count_token(x["text"], term))
            paths = F.concat(paths, F.transform(hit, lambda x: x["path"]))
        found = self.base.where(self.has_any([term]) & F.lit(term == term.lower()))
        return found.select("doc_id", tf.cast("long").alias("tf"), F.array_sort(F.array_distinct(paths)).alias("field_paths"))

    def term_with_fields(self, term: str) -> DataFrame:
        """(doc_id, field_paths) of a term."""
        return self.get_postings(term).select("doc_id", "field_paths")

    def term_in_field(self, term: str, path: str) -> DataFrame:
        """Documents with the term in the field of exactly this path."""
        return self.get_postings(term).where(F.array_contains("field_paths", path)).select("doc_id")

    def term_in_segment(self, term: str, segment: str) -> DataFrame:
        """Documents with the term in a field that has this segment anywhere in its path."""
        return self.get_postings(term).where(F.exists("field_paths", lambda p: F.array_contains(F.split(p, r"\."), segment))).select("doc_id")

    def gram_terms(self, gram: str) -> DataFrame:
        """Terms with this n-gram; none if no n-gram has its length."""
        low, high = self.config.ngrams or (1, 0)
        return self.vocab.where(F.contains("term", F.lit(gram)) & F.lit(low <= len(gram) <= high)).select("term")

    def prefix_terms(self, prefix: str) -> DataFrame:
        """Terms of which some n-gram begins with the prefix."""
        return self.grams.where(F.startswith("gram", F.lit(prefix))).select("term").distinct()

    # --- look-ups by number

    @staticmethod
    def _in(key: Column, low: int | None, high: int | None, exclude: Sequence[float] = ()) -> Column:
        ok = key.isNotNull()
        if low is not None:
            ok &= key >= F.lit(low).cast("long")
        if high is not None:
            ok &= key <= F.lit(high).cast("long")
        if exclude:
            ok &= ~key.isin([X.scaled(v) for v in exclude])
        return ok

    def _plain_in(self, f: flatten.Field, low: int | None, high: int | None, exclude: Sequence[float] = ()) -> Column:
        """The same for a plain field, with bounds on the bare column that the scan can use; null where the field is."""
        ok = self._in(f.vkey, low, high, exclude)
        nan = (low is None or low <= 0) and (high is None or high >= 0)  # NaN has key 0 but lies within no bounds
        if f.kind == "number" and (f.integral or not nan):
            if low is not None:
                ok &= f.value >= (F.lit(-(-low // 1000)) if f.integral else F.lit((low - 1) / 1000 - abs(low) * 1e-12))
            if high is not None:
                ok &= f.value <= (F.lit(high // 1000) if f.integral else F.lit((high + 1) / 1000 + abs(high) * 1e-12))
        return ok

    def _found(self, plain: list[tuple[flatten.Field, Column]], match) -> DataFrame:
        """(doc_id, path, vkey) for the plain fields where their condition holds, and for the leaves that match."""
        out = lambda path, key: F.struct(path.alias("path"), key.cast("long").alias("vkey"))
        if len(plain) == 1 and not self.nested:
            f, ok = plain[0]
            return self.base.where(ok).select("doc_id", F.lit(f.path).alias("path"), f.vkey.alias("vkey"))
        found = F.array_compact(F.array(*[F.when(ok, out(F.lit(f.path), f.vkey)) for f, ok in plain])) if plain else F.array().cast("array<struct<path:string,vkey:bigint>>")
        rows = self.base
        if self.nested:
            found = F.concat(found, F.transform(F.filter("leaves", match), lambda x: out(x["path"], x["vkey"])))
        else:
            rows = rows.where(_some(ok for _, ok in plain))
        return rows.select("doc_id", F.explode_outer(found).alias("f")).select("doc_id", "f.path", "f.vkey").where("path is not null")

    def _pairs(self, what: str, name: str, low: int | None, high: int | None, exclude: Sequence[float] = ()) -> DataFrame:
        plain = [(f, self._plain_in(f, low, high, exclude)) for f in self.plain if getattr(f, what) == name and f.kind != "text"]
        return self._found(plain, lambda x: F.coalesce((x[what] == name) & self._in(x["vkey"], low, high, exclude), F.lit(False)))

    def has_value(self, field: str, low: int | None, high: int | None) -> Column:
        """Whether a row of ``base`` has a number in a field of this name (last segment) between two keys."""
        hits = [f.value.isNotNull() & self._plain_in(f, low, high) for f in self.plain if f.leaf == field and f.kind != "text"]
        if self.nested:
            hits.append(F.exists("leaves", lambda x: F.coalesce((x["leaf"] == field) & self._in(x["vkey"], low, high), F.lit(False))))
        return _some(hits)

    def range(self, path: str, low: float, high: float) -> DataFrame:
        """(doc_id, path, vkey) where the field of exactly this path lies between the bounds, both included."""
        return self._pairs("path", path, X.scaled(low), X.scaled(high))

    def compare(self, field: str, low: float | None = None, high: float | None = None, exclude: Sequence[float] = ()) -> DataFrame:
        """The same by the path's last segment, with optional bounds and excluded values; a pair for each field."""
        return self._pairs("leaf", field, None if low is None else X.scaled(low), None if high is None else X.scaled(high), exclude)

    def gt(self, field: str, n: float, exclude: Sequence[float] = (), strict: bool = False) -> DataFrame:
        """From n + 1 on: values strictly between n and n + 1 don't match, unless ``strict`` asks for all above n."""
        if strict:
            return self._pairs("leaf", field, X.scaled(n) + 1, None, exclude)
        return self.compare(field, n + 1, None, exclude)

    def gte(self, field: str, n: float, exclude: Sequence[float] = ()) -> DataFrame:
        return self.compare(field, n, None, exclude)

    def lt(self, field: str, n: float, exclude: Sequence[float] = (), strict: bool = False) -> DataFrame:
        """Up to n - 1, or with ``strict`` all below n."""
        if strict:
            return self._pairs("leaf", field, None, X.scaled(n) - 1, exclude)
        return self.compare(field, None, n - 1, exclude)

    def lte(self, field: str, n: float, exclude: Sequence[float] = ()) -> DataFrame:
        return self.compare(field, None, n, exclude)

    def between(self, field: str, low: float, high: float, exclude: Sequence[float] = ()) -> DataFrame:
        """Both bounds included; nothing if they are the wrong way round."""
        return self.compare(field, low, high, exclude)

    def date_between(self, field: str, low: str, high: str) -> DataFrame:
        """Documents with a date in a field of this name between two dates (Y-M-D), both included."""
        key = lambda s: sum(int(p) * m for p, m in zip(s.split("-"), (10000, 100, 1), strict=True))
        first, last = key(low), key(high)
        plain = []
        for f in self.plain:
            if f.leaf == field and f.kind == "date":
                ok = self._in(f.vkey, first, last)
                try:  # on the bare column, for the scan
                    ok &= (f.value >= F.lit(datetime.date.fromisoformat(low))) & (f.value < F.lit(datetime.date.fromisoformat(high) + datetime.timedelta(1)))
                except ValueError:
                    pass
                plain.append((f, ok))
        return self._found(plain, lambda x: F.coalesce((x["leaf"] == field) & (x["kind"] == "date") & x["vkey"].between(first, last), F.lit(False)))

    # --- sorting

    def _numbers(self, match, leaf_match) -> tuple[list[flatten.Field], Column | None]:
        """The plain number fields whose path matches, and the leaves that do."""
        plain = [f for f in self.plain if f.kind == "number" and match(f.path)]
        return plain, F.filter("leaves", lambda x: (x["kind"] == "number") & leaf_match(x)) if self.nested else None

    @staticmethod
    def _best(values: list[Column], pick) -> Column:
        """The least or greatest of some columns; null if all are."""
        return F.lit(None) if not values else values[0] if len(values) == 1 else pick(*values)

    def _suffix_key(self, suffix: str) -> Column:
        plain, hits = self._numbers(lambda p: p.endswith(suffix), lambda x: F.endswith(x["path"], F.lit(suffix)))
        if hits is None:
            order = sorted(plain, key=lambda f: (len(f.path), f.path), reverse=True)
            return F.coalesce(*[f.value.cast("double") for f in order]) if order else F.lit(None).cast("double")
        place = lambda path, num: F.struct(F.length(path).alias("n"), path.alias("path"), num.cast("double").alias("num"))
        own = F.array_compact(F.array(*[F.when(f.value.isNotNull(), place(F.lit(f.path), f.value)) for f in plain])) if plain else None
        found = F.transform(hits, lambda x: place(x["path"], x["num"]))
        return F.array_max(found if own is None else F.concat(own, found))["num"]

    def sort_columns(self, fields: Sequence[tuple[str, bool]]) -> tuple[list[Column], list[Column]]:
        """Keys over ``base`` and ordering of ``sort_by``: per field (suffix, ascending), the number at the longest path that ends so."""
        keys = [self._suffix_key(s).alias(f"key_{i}") for i, (s, _) in enumerate(fields)]
        return keys, self._order(fields)

    @staticmethod
    def _order(fields: Sequence[tuple[str, bool]]) -> list[Column]:
        return [F.col(f"key_{i}").asc_nulls_last() if asc else F.col(f"key_{i}").desc_nulls_first() for i, (_, asc) in enumerate(fields)]

    def sort_by(self, fields: Sequence[tuple[str, bool]]) -> DataFrame:
        """All documents with key columns, in order: nulls last ascending, first descending; ties by doc_id."""
        keys, order = self.sort_columns(fields)
        got = self.base.select("doc_id", *keys)
        return got.orderBy(*order, F.col("doc_id").asc()) if fields else got

    def sort_by_leaf(self, fields: Sequence[tuple[str, bool]]) -> DataFrame:
        """The same with keys by the last segment: the least match ascending, the greatest descending."""
        def key(name: str, asc: bool) -> Column:
            plain, hits = self._numbers(lambda p: p.rpartition(".")[2] == name, lambda x: x["leaf"] == name)
            values = [f.value.cast("double") for f in plain]
            if hits is not None:
                values.append((F.array_min if asc else F.array_max)(F.transform(hits, lambda x: x["num"])))
            return self._best(values, F.least if asc else F.greatest)

        got = self.base.select("doc_id", *[key(s, asc).cast("double").alias(f"key_{i}") for i, (s, asc) in enumerate(fields)])
        return got.orderBy(*self._order(fields), F.col("doc_id").asc()) if fields else got

    def sort_by_substring(self, part: str, ascending: bool = True) -> DataFrame:
        """Documents with a number under a path that contains ``part``, by the greatest such whole number."""
        plain, hits = self._numbers(lambda p: part in p, lambda x: F.contains(x["path"], F.lit(part)))
        values = [F.when(f.value.isNotNull(), X.whole(f.value)) for f in plain]
        if hits is not None:
            values.append(F.array_max(F.transform(hits, lambda x: X.whole(x["num"]))))
        got = self.base.select("doc_id", self._best(values, F.greatest).cast("long").alias("key_0")).where("key_0 is not null")
        return got.orderBy(F.col("key_0").asc() if ascending else F.col("key_0").desc(), F.col("doc_id").asc())

    def sort_by_path(self, path: str, ascending: bool = True, among: DataFrame | None = None) -> DataFrame:
        """Documents by the value key at exactly this path; those without are left out, and those not ``among``."""
        got = self._pairs("path", path, None, None).select("doc_id", F.col("vkey").alias("key_0"))
        if among is not None:
            got = got.join(among.select("doc_id"), "doc_id", "left_semi")
        return got.orderBy(F.col("key_0").asc() if ascending else F.col("key_0").desc(), F.col("doc_id").asc())

    # --- ranking

    def _scores(self, weights: dict[str, float], k1: float, b: float) -> DataFrame:
        """(doc_id, score): the weighted BM25 sum over terms of the driver.

        One aggregation gives document count, total length and the terms' document frequencies (a few
        numbers); then one narrow scan scores. Terms are few, so their frequencies are part of the plan.
        """
        terms = list(weights)
        low = F.size("tokens").cast("long")
        seen = [F.sum(F.array_contains("tokens", t).cast("long")).alias(f"df_{i}") for i, t in enumerate(terms)]
        row = self.docs.agg(F.sum((low > 0).cast("long")).alias("n"), F.sum(low).alias("total"), *seen).first()
        n, total = row["n"] or 0, row["total"] or 0
        if not terms or not n:
            return self.docs.select("doc_id", F.lit(0.0).alias("score")).where(F.lit(False))
        avgdl = total / n
        hits = F.filter("tokens", lambda x: x.isin(terms))
        per_doc = self.docs.select("doc_id", low.alias("dl"), hits.alias("hits"))

        def part(i: int, t: str) -> Column:
            df = row[f"df_{i}"] or 0
            idf = F.log((F.lit(float(n)) - df + 0.5) / (F.lit(float(df)) + 0.5) + 1.0)
            tf = F.size(F.filter("hits", lambda x: x == F.lit(t))).cast("double")
            return F.lit(float(weights[t])) * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / avgdl))

        score = reduce(lambda x, y: x + y, [part(i, t) for i, t in enumerate(terms)])
        # A filter on hits would move below the projection and tokenize each text a second time; a generator's output doesn't.
        found = F.explode_outer(F.when(F.size("hits") > 0, F.array(score)).otherwise(F.array().cast("array<double>")))
        return per_doc.select("doc_id", found.alias("score")).where("score is not null")

    def bm25(self, terms: Sequence[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(doc_id, score) of documents with any of the terms, best first; a term given twice counts twice."""
        given = [stem.stem(t.lower()) if self.config.use_stemming else t.lower() for t in terms]
        weights = {t: float(given.count(t)) for t in dict.fromkeys(given)}
        return self._scores(weights, k1, b).orderBy(F.col("score").desc(), F.col("doc_id").asc())

    def candidates(self, query: str, alpha: float = 0.6, beta: float = 0.4, top_k: int = 10, squared: bool = False) -> DataFrame:
        """(term, hits, w): the ``top_k`` terms of the vocabulary that come closest to the query.

        ``hits`` counts the query's n-grams that a term contains, ``w`` mixes hits per query word (or per its
        square) with the edit similarity of the whole query. Terms without a hit drop out before the shuffle.
        """
        low, high = self.config.ngrams or (1, 0)
        words = X.query_words(query)
        if self.config.use_stemming:
            words = [stem.stem(w) for w in words]
        grams: dict[str, int] = {}
        for w in words:
            for g in X.text_ngrams(w, low, high):
                grams[g] = grams.get(g, 0) + 1
        hits = reduce(lambda a, g: a + F.when(F.contains("term", F.lit(g[0])), g[1]).otherwise(0), grams.items(), F.lit(0))
        whole = " ".join(words)
        terms = self.docs.select(F.explode(F.array_distinct("tokens")).alias("term")).select("term", hits.cast("long").alias("hits")).where("hits > 0").distinct()
        over = float(max(len(words) ** 2 if squared else len(words), 1))
        edit = 1.0 - F.levenshtein(F.lit(whole), F.col("term")) / F.greatest(F.length("term"), F.lit(1))
        w = F.lit(alpha) * (F.col("hits") / F.lit(over)) + F.lit(beta) * edit
        return terms.select("term", "hits", w.alias("w")).orderBy(F.col("w").desc(), F.col("term").desc()).limit(top_k)

    def ngram_bm25(self, query: str, k1: float = 1.2, b: float = 0.75, alpha: float = 0.6, beta: float = 0.4, top_k: int = 10, squared: bool = False) -> DataFrame:
        """(doc_id, score), best first: BM25 of the ``top_k`` candidate terms (of words, not documents) by their weights."""
        if not self.config.ngrams:
            return self._scores({}, k1, b)
        found = {r.term: r.w for r in self.candidates(query, alpha, beta, top_k, squared).collect()}
        return self._scores(found, k1, b).orderBy(F.col("score").desc(), F.col("doc_id").asc())

    def ngram_bm25_old(self, query: str, **options) -> DataFrame:
        """The earlier weighting: hits over the squared number of query words."""
        return self.ngram_bm25(query, squared=True, **options)

    # --- query language

    def query(self, text: str) -> DataFrame:
        from siftwell.plans import lang

        return lang.run(self, text)
