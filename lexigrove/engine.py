"""What a user of the engine calls: search, statistics, documents, ingestion."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexigrove.collection import Collection
from lexigrove.operators import feedback, inspect, reformulate, snippets
from lexigrove.plans.compile import Compiler, Config, ranked
from lexigrove.plans.parser import parse
from lexigrove.plans.xpath import parse_paths


@dataclass
class Request:
    query: str
    k: int = 1000
    start: int = 0
    language: str = "structured"  # or "paths"
    metadata: list[str] = field(default_factory=list)
    snippets: str | None = None  # "html" or "text"
    doc_ids: DataFrame | None = None
    expansion: str | None = None  # "rm", "ponte" or "rocchio"
    expansion_options: dict = field(default_factory=dict)


@dataclass
class Answer:
    results: DataFrame
    query: str
    estimated_matches: int
    seconds: dict[str, float]


class Engine:
    """Queries over one collection; several collections are one by Collection.append."""

    def __init__(self, collection: Collection, config: Config | None = None) -> None:
        self.c = collection
        self.config = config or Config()

    def parse(self, query: str, language: str = "structured"):
        return parse_paths(query) if language == "paths" else parse(query)

    def search(self, query: str, k: int = 1000, start: int = 0, language: str = "structured", doc_ids: DataFrame | None = None) -> DataFrame:
        """(doc_id, begin, end, score), best first. With doc_ids, just these documents, all of them."""
        return ranked(Compiler(self.c, self.config).run(self.parse(query, language), doc_ids), k, start)

    def search_many(self, queries: dict[str, str], k: int = 1000, language: str = "structured") -> DataFrame:
        """(query, rank, doc_id, begin, end, score) of several queries, each its best k; one plan, so that Spark runs them side by side."""
        parts = [self.search(q, k, language=language).select(F.lit(n).alias("query"), "doc_id", "begin", "end", "score") for n, q in queries.items()]
        if not parts:
            raise ValueError("no queries")
        order = W.partitionBy("query").orderBy(*[F.desc(c) for c in ("score", "doc_id", "begin", "end")])
        return reduce(DataFrame.unionAll, parts).select("query", F.row_number().over(order).alias("rank"), "doc_id", "begin", "end", "score")

    def search_all(self, query: str, language: str = "structured", doc_ids: DataFrame | None = None) -> DataFrame:
        return Compiler(self.c, self.config).run(self.parse(query, language), doc_ids)

    def request(self, r: Request) -> Answer:
        t0 = time.perf_counter()
        query = self.expand(r.query, r.expansion, **r.expansion_options) if r.expansion else r.query
        t1 = time.perf_counter()
        out = self.search(query, r.k, r.start, r.language, r.doc_ids)
        t2 = time.perf_counter()
        for key in r.metadata:
            out = out.join(inspect.metadata_values(self.c, key).withColumnRenamed("value", key), "doc_id", "left")
        if r.snippets:
            out = out.join(snippets.snippets(self.c, query, out, marked=r.snippets == "html"), "doc_id", "left")
        return Answer(out, query, self.estimated_matches(r.query, r.language), {"expand": t1 - t0, "plan": t2 - t1, "fetch": time.perf_counter() - t2})

    def expand(self, query: str, model: str = "rm", **options) -> str:
        makers = {"rm": feedback.expand_rm, "ponte": feedback.expand_ponte, "rocchio": feedback.expand_rocchio}
        return makers[model](self.c, query, config=self.config, **options)

    def annotate(self, query: str, k: int = 1000, doc_ids: DataFrame | None = None) -> DataFrame:
        return snippets.annotate(self.c, query, self.search(query, k, doc_ids=doc_ids))

    def snippets(self, query: str, k: int = 10, **options) -> DataFrame:
        return snippets.snippets(self.c, query, self.search(query, k), **options)

    def reformulate(self, query: str, **options) -> str:
        return reformulate.reformulate(query, **options)

    def estimated_matches(self, query: str, language: str = "structured") -> int:
        """The greatest document frequency of a leaf."""
        from lexigrove.plans import rewrite

        node = rewrite.prepare(self.parse(query, language), self.c.term)
        compiler = Compiler(self.c, self.config)
        counts = compiler.counts([leaf for leaf in _leaves(node)])
        return int(max((v.documents for v in counts.values()), default=0))

    # documents

    def documents(self, doc_ids: DataFrame) -> DataFrame:
        return self.c.docs.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")

    def metadata(self, key: str, doc_ids: DataFrame | None = None) -> DataFrame:
        return inspect.metadata_values(self.c, key, doc_ids)

    def by_metadata(self, key: str, values: list[str]) -> DataFrame:
        return inspect.by_metadata(self.c, key, values)

    def path_names(self, results: DataFrame) -> DataFrame:
        return inspect.path_names(self.c, results)

    def process_term(self, word: str) -> str | None:
        return self.c.term(word)

    def vectors(self, doc_ids: DataFrame | None = None) -> DataFrame:
        return inspect.document_vectors(self.c, doc_ids)

    def fields(self) -> list[str]:
        return sorted(r[0] for r in self.c.fields.select("field").distinct().collect())

    # counts

    def term_count(self, term: str | None = None, processed: bool = False) -> int:
        if term is None:
            return int(Compiler(self.c).totals()[0])
        t = term if processed else self.c.term(term)
        return self.c.tokens.filter(self.c.tokens["term"] == t).count() if t else 0

    def term_count_unique(self) -> int:
        return self.c.tokens.select("term").dropna().distinct().count()

    def term_field_count(self, term: str, field_name: str) -> int:
        return self.expression_count(f'"{self.c.term(term)}".{field_name}')

    def document_count(self, term: str | None = None) -> int:
        """Documents, deleted ones left out; or documents with the term."""
        if term is None:
            return inspect.corpus_stats(self.c).first()["n_docs"]
        return self.c.tokens.filter(self.c.tokens["term"] == self.c.term(term)).select("doc_id").distinct().count()

    def document_length(self, doc_id) -> int:
        row = self.c.lengths().filter(self.c.lengths()["doc_id"] == doc_id).first()
        return int(row["length"]) if row else 0

    def expression_count(self, text: str) -> int:
        return inspect.expression_totals(self.c, text).first()["cf"]

    def document_expression_count(self, text: str) -> int:
        return inspect.expression_totals(self.c, text).first()["df"]

    def expression_list(self, text: str) -> DataFrame:
        return inspect.expression_list(self.c, text)


def _leaves(node):
    from lexigrove.plans import ast as A

    return [node] if isinstance(node, A.Leaf) else [x for c in A.children(node) for x in _leaves(c)]
