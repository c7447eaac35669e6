"""Requests to plans.

Every clause becomes a predicate or a score, so that a request of any shape is
one filter and one bounded sort. Over a written index (`Index.store`) text
clauses are one lookup of postings, pruned to the folders of the request's
terms, with a row for each document that has any; documents themselves are
read only where another clause, an order or the fields asked for need them,
and fields of a page by relevance only for the page. Without one, texts are
analysed in the scan. Document frequencies are as many numbers as the query
has terms.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo, text
from ..operators.index import Store, bucket_of
from ..operators.vocab import Pinyin
from ..schema import FieldSpec, IndexSpec
from . import dsl

#: The number of documents that scores assume, and how fast repeats of a term stop counting.
N_DOCS, K1, K = 10_000, 1.2, 1.65
HIGHLIGHTS = 10
#: Terms that a batch of requests looks up by constants, and its terms that are sent to the postings.
FEW, SENT = 200, 200_000


def term_score(df: Column, tf: Column, n_docs: int = N_DOCS) -> Column:
    return F.log(F.greatest(n_docs - df + 0.5, F.lit(0.5)) / (df + 0.5)) * ((K1 + 1) * tf / (K + tf))


def occurrences(terms: Column, term: str) -> Column:
    return F.size(F.filter(terms, lambda x: x == term))


@dataclass
class Index:
    """Documents of one application, and the index written for them, if any.

    `n_docs` is what scores assume; `counted` takes the real number. `pinyin`
    answers matches on fields of that analyzer.
    """

    spec: IndexSpec
    docs: DataFrame
    store: Store | None = None
    n_docs: int = N_DOCS
    pinyin: Pinyin | None = None
    sensitive: frozenset[str] = frozenset()
    synonyms: Mapping[str, Sequence[str]] = field(default_factory=dict)

    @property
    def key(self) -> Column:
        return F.col(self.spec.key)

    def counted(self) -> Index:
        """The same index with the number of its documents in place of the assumed one."""
        return replace(self, n_docs=self.store.n_docs if self.store else self.docs.count())


@dataclass
class Result:
    """`rows`: doc_id, score and the fields asked for; the others are plans of their own, run when used."""

    rows: DataFrame
    matched: DataFrame
    highlight: DataFrame | None

    def count(self) -> int:
        return self.matched.count()

    def envelope(self) -> dict:
        """The page as a client gets it; a page is small by definition."""
        words = [r[0] for r in self.highlight.collect()] if self.highlight is not None else []
        return {"code": 0, "type": 0, "count": self.count(), "result": [r.asDict(recursive=True) for r in self.rows.collect()], "hlWord": words}


class Compiler:
    """One request against one index."""

    def __init__(self, index: Index, request: dsl.Request):
        self.index, self.request = index, request
        self.terms: dict[str, list[str]] = {}  # scored terms of each text field
        self.analyzed: set[str] = set()
        self.hits: dict[tuple[str, str], str] = {}  # looked-up (field, term) and the column of its tf
        self.reads_docs = False  # whether a clause needs more than postings
        self.distance: Column | None = None

    def tokens(self, spec: FieldSpec, words: str) -> list[str]:
        """The query's terms by the field's own analyzer; sensitive words count for nothing."""
        local = self.index.docs.sparkSession.sql("SELECT * FROM VALUES (:w) AS v(w)", args={"w": words})  # no job: evaluated while planning
        row = local.select(text.analyze(spec.analyzer, F.col("w")).alias("t")).first()
        found = [t for t in dict.fromkeys(row["t"]) if t not in self.index.sensitive]
        if self.request.options.get("synonyms"):
            found = list(dict.fromkeys(x for t in found for x in (t, *self.index.synonyms.get(t, ()))))
        return found

    @staticmethod
    def analyzed_name(name: str) -> str:
        return f"__terms_{name}"

    def point(self, name: str) -> tuple[Column, Column]:
        return F.col(name)["lat"], F.col(name)["lng"]

    def looked_up(self, spec: FieldSpec) -> bool:
        return self.index.store is not None and spec.indexed and spec.kind in ("string", "text") and spec.analyzer in ("word", "keyword", "ngram")

    def tf(self, name: str, term: str) -> Column:
        """How often a document has a term: by lookup, or by its analysed text."""
        if self.looked_up(self.index.spec[name]):
            return F.coalesce(F.col(self.hits.setdefault((name, term), f"__tf{len(self.hits)}")), F.lit(0))
        self.analyzed.add(name)
        return occurrences(F.col(self.analyzed_name(name)), term)

    def has_any(self, name: str, terms: Sequence[str]) -> Column:
        if not terms:
            return F.lit(False)
        if self.looked_up(self.index.spec[name]):
            return F.greatest(F.lit(0), F.lit(0), *[self.tf(name, t) for t in terms]) > 0
        self.analyzed.add(name)
        return F.coalesce(F.arrays_overlap(F.col(self.analyzed_name(name)), F.array(*map(F.lit, terms))), F.lit(False))

    def clause(self, q, scored: bool) -> Column:
        spec = self.index.spec[q.field]
        by_terms = isinstance(q, (dsl.Match, dsl.Term)) and self.looked_up(spec)
        self.reads_docs |= not by_terms
        c = F.col(q.field)
        if isinstance(q, dsl.Match) and spec.analyzer == "pinyin" and self.index.pinyin is not None:
            return self.index.pinyin.matches_word(c, q.text, spec.anywhere)
        if isinstance(q, dsl.Match) and spec.analyzer == "letters":
            wanted = F.regexp_replace(F.lower(F.lit(q.text)), "[^a-z]", "")
            letters = F.regexp_replace(F.lower(c), "[^a-z]", "")
            return letters.contains(wanted) if spec.anywhere else letters.startswith(wanted)
        if isinstance(q, dsl.Match) and spec.kind in ("string", "text"):
            found = self.tokens(spec, q.text)
            if scored:
                self.terms[q.field] = list(dict.fromkeys([*self.terms.get(q.field, []), *found]))
            return self.has_any(q.field, found)
        if isinstance(q, (dsl.Term, dsl.Match)):
            value = q.value if isinstance(q, dsl.Term) else q.text
            if spec.kind == "ip":
                return text.ip_to_long(c) == text.ip_to_long(F.lit(str(value)))
            if spec.indexed:
                if by_terms or spec.kind in ("string", "text") and spec.analyzer == "word":
                    return self.has_any(q.field, [str(value)])
                return c == F.lit(value).cast(spec.type)
            return self.post_filter(spec, value)
        if isinstance(q, dsl.Range):
            if spec.kind not in ("int", "long", "double"):
                raise dsl.QueryError(f"{q.field} has no range")
            out = F.lit(True)
            if q.low is not None:
                out = c > q.low if q.low_open else c >= q.low
            if q.high is not None:
                high = c < q.high if q.high_open else c <= q.high
                out = high if q.low is None else out & high
            return out
        if isinstance(q, dsl.GeoDistance):
            lat, lng = self.point(q.field)
            d = geo.planar_km(lat, lng, *q.centre)
            if scored:
                self.distance = d if self.distance is None else self.distance
            return geo.within_box(lat, lng, *q.centre, q.km) & (d + 1e-6 <= q.km) if q.km else d.isNotNull()
        if isinstance(q, dsl.GeoPolygon):
            lat, lng = self.point(q.field)
            return (geo.in_polygon if q.exact else geo.in_polygon_cells)(lat, lng, q.vertices)
        raise dsl.QueryError(f"no clause {q}")

    def post_filter(self, spec: FieldSpec, value) -> Column:
        """A term on a field that is only stored: lists with `|`, doubles within 1e-15."""
        c, parts = F.col(spec.name), str(value).split("|")
        if spec.kind in ("int", "long"):
            return c.isin([int(p) for p in parts])
        if spec.kind == "double":
            return F.abs(c - float(value)) < 1e-15
        return F.coalesce(F.arrays_overlap(F.split(c, r"\|"), F.array(*map(F.lit, parts))), F.lit(False))

    def predicate(self) -> Column:
        q = self.request.query
        if not isinstance(q, dsl.Bool):
            return self.clause(q, True)
        out = F.lit(True)
        if q.should:
            any_of = [F.coalesce(self.clause(c, True), F.lit(False)) for c in q.should]
            one = any_of[0]
            for c in any_of[1:]:
                one = one | c
            out = one
        for c in q.must:
            out = out & F.coalesce(self.clause(c, True), F.lit(False))
        for c in q.must_not:
            out = out & ~F.coalesce(self.clause(c, False), F.lit(False))
        return out

    def needs_hit(self, q) -> bool:
        """Whether no document without a looked-up term can match."""
        if isinstance(q, dsl.Bool):
            return any(map(self.needs_hit, q.must)) or bool(q.should) and all(map(self.needs_hit, q.should))
        return isinstance(q, (dsl.Match, dsl.Term)) and self.looked_up(self.index.spec[q.field])

    def hit_rows(self) -> DataFrame:
        """__hit (the document's id) and the tf of each looked-up term: one row a document."""
        store = self.index.store
        found = store.lookup(store.postings, self.hits)
        tfs = [F.max(F.when((F.col("field") == f) & (F.col("term") == t), F.col("tf"))).alias(name) for (f, t), name in self.hits.items()]
        return found.groupBy(F.col("doc_id").alias("__hit")).agg(*tfs)

    def matched(self) -> tuple[DataFrame, Column]:
        """The rows that match, with __id, and their score."""
        keep, r = self.predicate(), self.request
        pairs = [(f, t) for f, ts in self.terms.items() for t in ts] if r.sort == "relevance" and self.distance is None else []
        tfs = [self.tf(f, t) for f, t in pairs]
        whole = self.reads_docs or r.sort in ("asc", "desc") or not self.needs_hit(r.query)
        if self.hits and not whole:
            rows = self.hit_rows().withColumn("__id", F.col("__hit"))
        else:
            rows = self.index.docs.withColumn("__id", self.index.key.cast("string"))
            for name in self.analyzed:
                rows = rows.withColumn(self.analyzed_name(name), text.analyze(self.index.spec[name].analyzer, F.col(name)))
            if self.hits:
                rows = rows.join(self.hit_rows(), F.col("__id") == F.col("__hit"), "inner" if self.needs_hit(r.query) else "left")
        rows = rows.where(keep)
        if self.distance is not None:
            return rows, self.distance
        if pairs:
            score = None
            for n, tf in zip(self.frequencies(pairs), tfs, strict=True):
                one = term_score(F.lit(n), tf, self.index.n_docs)
                score = one if score is None else score + one
            return rows, F.coalesce(score, F.lit(0.0))
        return rows, F.lit(1.0) if r.sort in ("none", "relevance") else F.lit(0.0)

    def frequencies(self, pairs: list[tuple[str, str]]) -> list[int]:
        stored = [p for p in pairs if p in self.hits]
        known = self.index.store.frequencies(stored) if stored else {}
        rest = [p for p in pairs if p not in self.hits]
        if rest:
            docs = self.index.docs.select(*[text.analyze(self.index.spec[f].analyzer, F.col(f)).alias(f) for f in sorted({f for f, _ in rest})])
            known |= dict(zip(rest, docs.agg(*[F.coalesce(F.sum(F.array_contains(F.col(f), t).cast("long")), F.lit(0)) for f, t in rest]).first(), strict=True))
        return [known.get(p, 0) for p in pairs]

    def highlight(self, rows: DataFrame) -> DataFrame | None:
        """Distinct matched words, the first HIGHLIGHTS in byte order."""
        pairs = [(f, t) for f, ts in self.terms.items() for t in ts]
        if not pairs or self.distance is not None:
            return None
        flags = rows.agg(*[F.max(self.tf(f, t) > 0).alias(f"h{i}") for i, (f, t) in enumerate(pairs)])
        words = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(F.col(f"h{i}"), F.lit(t)) for i, (_, t) in enumerate(pairs)]), lambda x: x.isNotNull())))
        return flags.select(F.explode(F.slice(words, 1, HIGHLIGHTS)).alias("word"))

    def result(self) -> Result:
        r, spec = self.request, self.index.spec
        rows, score = self.matched()
        doc_id = F.col("__id").alias("doc_id")
        names = [n for n in r.fields if n in spec.fields and n in self.index.docs.columns and spec[n].stored]
        later = bool(names) and spec.key not in rows.columns  # fields of the page are read once the page is known
        shown = [] if later else [F.col(n) for n in names]
        if r.sort in ("asc", "desc"):
            by = F.col(r.sort_field) if r.sort_field in rows.columns else None
            if by is None:
                raise dsl.QueryError(f"no field {r.sort_field} to sort by")
            picked = rows.select(doc_id, by.alias("score"), *shown)
            if r.after is not None:
                score0, id0 = F.lit(r.after[0]).cast(picked.schema["score"].dataType), F.lit(str(r.after[1]))
                s, d = F.col("score"), F.col("doc_id")
                past = (s > score0) | ((s == score0) & (d > id0)) if r.sort == "asc" else (s < score0) | ((s == score0) & (d < id0))
                picked = picked.where(past)
            order = [F.asc_nulls_last("score"), F.asc("doc_id")] if r.sort == "asc" else [F.desc_nulls_last("score"), F.desc("doc_id")]
        else:
            picked = rows.select(doc_id, (F.lit(1.0) if r.sort == "none" else score).alias("score"), *shown)
            near = self.distance is not None and r.sort in ("relevance", "distance")
            order = [F.asc("score"), F.asc("doc_id")] if near else [F.desc("score"), F.desc("doc_id")]
        page = picked.orderBy(*order)
        if not r.everything:
            skip = 0 if r.after is not None else r.offset if r.offset is not None else (r.page - 1) * r.size
            page = (page.offset(skip) if skip else page).limit(r.size)
        if later:
            fields = self.index.docs.select(self.index.key.cast("string").alias("__id"), *[F.col(n).alias(f"__f{i}") for i, n in enumerate(names)])
            page = page.join(fields, F.col("doc_id") == F.col("__id")).select("doc_id", "score", *[F.col(f"__f{i}").alias(n) for i, n in enumerate(names)]).orderBy(*order)
        return Result(page, picked.select("doc_id"), self.highlight(rows))


def search(index: Index, request: dict) -> Result:
    """Answers one request; nothing but document frequencies runs until the result is used."""
    return Compiler(index, dsl.parse(request)).result()


def shard_of(key: Column, shards: int) -> Column:
    """The shard that a document goes to: by its key alone, so that writes and point reads agree."""
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(shards)).cast("int")


def search_shards(shards: Sequence[Index], request: dict) -> Result:
    """One request over several indexes: each gives its first rows up to the page's end, and these are merged.

    A document that several shards have counts once, with its better place.
    Scores use each shard's own frequencies, as separate servers would. Counts
    and highlights are over all shards.
    """
    parsed = dsl.parse(request)
    skip = 0 if parsed.after is not None else parsed.offset if parsed.offset is not None else (parsed.page - 1) * parsed.size
    upto = {k: v for k, v in request.items() if k not in ("page_index", "from", "page_size", "size", "offset")} | {"page_size": skip + parsed.size}
    compilers = [Compiler(x, dsl.parse(upto)) for x in shards]
    found = [c.result() for c in compilers]
    rows, matched = found[0].rows, found[0].matched
    for x in found[1:]:
        rows, matched = rows.unionByName(x.rows, allowMissingColumns=True), matched.union(x.matched)
    rising = parsed.sort in ("asc", "distance") or compilers[0].distance is not None and parsed.sort == "relevance"
    order = [F.asc_nulls_last("score"), F.asc("doc_id")] if rising else [F.desc_nulls_last("score"), F.desc("doc_id")]
    best = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))
    page = rows.withColumn("__r", best).where("__r = 1").drop("__r").orderBy(*order)
    if not parsed.everything:
        page = (page.offset(skip) if skip else page).limit(parsed.size)
    words = [x.highlight for x in found if x.highlight is not None]
    highlight = None
    for w in words:
        highlight = w if highlight is None else highlight.union(w)
    return Result(page, matched.distinct(), None if highlight is None else highlight.distinct().orderBy("word").limit(HIGHLIGHTS))


def batch_search(postings: DataFrame, queries: DataFrame, k: int = 10, n_docs: int = N_DOCS) -> DataFrame:
    """Many queries as rows (query_id, term): the k best documents of each, in one job.

    Postings join the terms first and are then summed by query and document, so
    what is shuffled is what matched; ranks are cut to k before rows move.
    Repeated terms of a query count once.
    """
    asked = queries.select("query_id", "term").distinct()
    hits = postings.join(asked, "term")
    df = hits.groupBy("query_id", "term").agg(F.count("*").alias("df"))
    return _ranked(hits.join(df, ["query_id", "term"]), k, n_docs)


def batch_lookup(store: Store, queries: DataFrame, field: str, k: int = 10, n_docs: int = N_DOCS) -> DataFrame:
    """`batch_search` over a written index: statistics are joined, not counted.

    Up to FEW different terms are looked up by constants, which reads their
    folders only; more are joined by bucket and term. Up to SENT terms of
    requests go to where the postings are, which then need not move.
    """
    asked = queries.select("query_id", "term", bucket_of(F.col("term"), store.buckets).alias("bucket")).distinct()
    some = [(field, r[0]) for r in asked.select("term").where("term is not null").distinct().limit(FEW + 1).collect()]
    of = (lambda t: store.lookup(t, some)) if len(some) <= FEW else (lambda t: t.where(F.col("field") == field))
    known = asked.join(of(store.stats).select("bucket", "term", "df"), ["bucket", "term"])
    known = F.broadcast(known) if asked.limit(SENT + 1).count() <= SENT else known
    hits = of(store.postings).select("bucket", "term", "doc_id", "tf").join(known, ["bucket", "term"])
    return _ranked(hits, k, n_docs)


def _ranked(hits: DataFrame, k: int, n_docs: int) -> DataFrame:
    scored = hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(term_score(F.col("df"), F.col("tf"), n_docs)), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("doc_id")))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


__all__ = ["Compiler", "Index", "Result", "batch_lookup", "batch_search", "search", "search_shards", "shard_of", "term_score"]
