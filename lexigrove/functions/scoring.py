"""Smoothed scores of a leaf as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Scores that users add: name -> function(parameters, tf, length, counts) -> Column. A rule `method:name,...` chooses one.
MODELS: dict[str, Callable[[dict[str, float], Column, Column, Counts], Column]] = {}

#: Names of the scorer nodes that a rule's `node` can choose, by where a leaf stands.
NODES = {"rawscorernode": "raw", "nestedrawscorernode": "nested", "shrinkagescorernode": "shrinkage"}


def register(name: str, model: Callable[[dict[str, float], Column, Column, Counts], Column]) -> None:
    """Makes `method:name` a score of leaves; names are compared in lower case, built-in ones can't be replaced."""
    if name.lower() in ("dirichlet", "jm", "twostage", "tfidf", "okapi"):
        raise ValueError(f"{name} is built in")
    MODELS[name.lower()] = model


@dataclass(frozen=True)
class Smoothing:
    """method and its parameters, e.g. Smoothing.of('method:jm,lambda:0.6')."""

    method: str = "dirichlet"
    params: dict[str, float] = field(default_factory=dict, hash=False)

    @property
    def document_level(self) -> bool:
        """Whether the model looks at the whole document's counts beside those of an extent or field."""
        p = self.params
        return self.method == "twostage" or (self.method == "jm" and bool(p.get("documentlambda"))) or (self.method == "dirichlet" and p.get("documentmu", -1.0) >= 0)

    @staticmethod
    def of(rule: str) -> Smoothing:
        pairs = dict(p.split(":", 1) for p in rule.replace(" ", "").split(",") if ":" in p)
        name = pairs.pop("method", "dirichlet").lower()
        numbers = {k.lower(): float(v) for k, v in pairs.items() if k not in ("field", "operator", "node")}
        aliases = {"d": "dirichlet", "dir": "dirichlet", "linear": "jm", "jelinek-mercer": "jm", "two": "twostage", "two-stage": "twostage"}
        name = aliases.get(name, name)
        if name not in ("dirichlet", "jm", "twostage", "tfidf", "okapi") and name not in MODELS:
            name, numbers = "dirichlet", {}
        return Smoothing(name, numbers)


def choose(rules: list[str], kind: str, fields: tuple[str, ...], node: str = "raw") -> Smoothing:
    """The last rule that fits: operator is term or window (the leaf's kind), field one of the leaf's fields, node the scorer that stands
    there (in whole documents, in restrictions, or smoothed over the tree); no rule: Dirichlet, mu 2500."""
    chosen = Smoothing()
    for rule in rules:
        pairs = dict(p.split(":", 1) for p in rule.replace(" ", "").split(",") if ":" in p)
        at = NODES.get(pairs.get("node", "").lower(), pairs.get("node"))
        if pairs.get("operator", kind) == kind and ("field" not in pairs or pairs["field"] in fields) and at in (None, node):
            chosen = Smoothing.of(rule)
    return chosen


@dataclass(frozen=True)
class Counts:
    """Of one leaf over the collection: occurrences, size of its context in tokens, documents; of the collection: documents, mean length."""

    occurrences: float
    context: float
    documents: float
    collection: float
    mean_length: float

    @property
    def share(self) -> float:
        """P(w | C); half an occurrence for what never occurs."""
        size = self.context or 1.0
        return self.occurrences / size if self.occurrences else 1.0 / (2 * size)


def score(s: Smoothing, tf: Column, length: Column, counts: Counts, simple: bool, query_tf: float = 1.0, doc_tf: Column | None = None, doc_length: Column | None = None) -> Column:
    """Log score of tf occurrences in `length` tokens.

    simple leaves are single terms in whole documents: document-level smoothing doesn't touch them. All others (windows,
    synonyms, fields, passages) take the document's own counts where a model has a document level; without any, tf and length stand for them.
    """
    p = s.params
    if s.method in MODELS:
        return MODELS[s.method](p, tf, length, counts)
    share = F.lit(counts.share)
    dtf = tf if doc_tf is None else doc_tf
    dlen = length if doc_length is None else doc_length
    safe = F.greatest(length, F.lit(1)).cast("double")
    dsafe = F.greatest(dlen, F.lit(1)).cast("double")
    if s.method == "jm":
        lam, dlam = p.get("lambda", p.get("collectionlambda", 0.4)), p.get("documentlambda", 0.0)
        if simple or not dlam:
            return F.log((1 - lam) * tf / safe + lam * share)
        return F.log((1 - lam - dlam) * tf / safe + dlam * dtf / dsafe + lam * share)
    if s.method == "twostage":
        mu, lam = p.get("mu", 2500.0), p.get("lambda", 0.4)
        if simple:
            return F.log((1 - lam) * (tf + mu * share) / (length + mu) + lam * share)
        return F.log((1 - lam) * (tf + mu * dtf / dsafe) / (length + mu) + lam * share)
    if s.method in ("tfidf", "okapi"):
        k1, b, k3 = p.get("k1", 1.2), p.get("b", 0.75), p.get("k3", 7.0)
        n, df = counts.collection, counts.documents
        if s.method == "tfidf":
            idf = F.log(F.lit((n + 1) / (df + 0.5)))
            weight, top = idf * 1000 * query_tf / (query_tf + 1000), k1
        else:
            idf = F.log(F.lit((n - df + 0.5) / (df + 0.5))) if n - df + 0.5 > 0 else F.lit(0.0)
            weight, top = F.lit((k3 + 1) * query_tf / (k3 + query_tf)), k1 + 1
        return weight * idf * top * tf / (tf + k1 * (1 - b) + k1 * b * length / F.lit(counts.mean_length or 1.0))
    mu, dmu = p.get("mu", 2500.0), p.get("documentmu", -1.0)
    if simple or dmu < 0:
        return F.log((tf + mu * share) / (length + mu))
    return F.log((tf + dmu * (mu * share + dtf) / (dlen + mu)) / (length + dmu))
