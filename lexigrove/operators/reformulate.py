"""Query strings into structured queries: stopping, and dependence models."""

from __future__ import annotations

import re
from collections.abc import Sequence

#: Words that light stopping takes out of queries.
LITE_STOP = (
    "a about am an and are as at be been being by did do does doing done for from had have has he in if is it its of on or "
    "that th the to was were will with"
).split()

FORBIDDEN = re.compile(r"[`~!@#$%^&*()_=+\[\]{}\\|;:'\",.<>/?-]")


def friendly(text: str) -> str:
    """Without the characters that mean something in the query language."""
    return re.sub(r"\s+", " ", FORBIDDEN.sub(" ", text)).strip()


def without_frames(text: str, frames: Sequence[str]) -> str:
    """Without the first of the frames, such as `what is the`, that the text begins with and that ends at a word's end; at most one is taken off."""
    for frame in frames:
        f = frame.strip()
        if f and text.startswith(f) and text[len(f) :][:1] in ("", " "):
            return text[len(f) :].lstrip()
    return text


def lite_stopped(text: str, stopwords=LITE_STOP) -> str:
    return " ".join(w for w in text.split() if w not in stopwords)


def _in_fields(expression: str, fields: dict[str, float] | None) -> str:
    return expression if not fields else "#wsum( " + " ".join(f"{w:g} {expression}.({f})" for f, w in fields.items()) + " )"


def combine_query(terms: list[str], fields: dict[str, float] | None = None) -> str:
    return "#combine( " + " ".join(_in_fields(t, fields) for t in terms) + " )"


def _weighted(terms: list[str], spans: list[tuple[int, int]], width, weights: tuple[float, float, float], fields) -> str:
    if len(terms) == 1:
        return combine_query(terms, fields)
    runs = [" ".join(terms[i:j]) for i, j in spans]
    single = " ".join(_in_fields(t, fields) for t in terms)
    ordered = " ".join(_in_fields(f"#1({r})", fields) for r in runs)
    loose = " ".join(_in_fields(f"#uw{width(j - i)}({r})", fields) for r, (i, j) in zip(runs, spans))
    return "#weight( " + " ".join(f"{w:g} #combine( {x} )" for w, x in zip(weights, (single, ordered, loose))) + " )"


def sequential_dependence(terms: list[str], weights=(0.85, 0.1, 0.05), fields: dict[str, float] | None = None) -> str:
    """Terms, neighbouring pairs as exact phrases, and pairs within eight words."""
    return _weighted(terms, [(i, i + 2) for i in range(len(terms) - 1)], lambda n: 8, weights, fields)


def full_dependence(terms: list[str], weights=(0.85, 0.1, 0.05), fields: dict[str, float] | None = None) -> str:
    """Terms, and every run of two or more as phrase and within four words a term."""
    return _weighted(terms, [(i, j) for i in range(len(terms)) for j in range(i + 2, len(terms) + 1)], lambda n: 4 * n, weights, fields)


def field_mixture_dependence(terms: list[str], fields: dict[str, float] | None = None, mixture: float = 1.0, dependency: float = 1.0, weights=(0.85, 0.1, 0.05)) -> str:
    """A mixture of fields for each term beside full dependence over the text."""
    fields = fields or dict.fromkeys(("url", "title", "body", "meta", "alt", "inlink"), 1.0)
    if len(terms) < 2:
        parts = (terms[0], f"#1({terms[0]})", f"#uw4({terms[0]})")
        dependence = "#weight( " + " ".join(f"{w:g} {x}" for w, x in zip(weights, parts)) + " )"
    else:
        dependence = full_dependence(terms, weights)
    return f"#weight( {mixture:g} {combine_query(terms, fields)} {dependency:g} {dependence} )"


def reformulate(query: str, model: str = "combine", frames: Sequence[str] = (), lite: bool = True, fields: dict[str, float] | None = None, **options) -> str:
    """A plain query as a structured one; model is combine, sdm, fdm or mixture. A query of which nothing is left becomes EMPTYQUERY.

    frames are question openings to be taken off, tried in their order (readers.frames reads a file of them); none are built in.
    """
    text = without_frames(friendly(query.lower()), frames)
    if lite:
        text = lite_stopped(text)
    terms = text.split()
    if not terms:
        return "EMPTYQUERY"
    makers = {"combine": combine_query, "sdm": sequential_dependence, "fdm": full_dependence, "mixture": field_mixture_dependence}
    return makers[model](terms, fields=fields, **options)
