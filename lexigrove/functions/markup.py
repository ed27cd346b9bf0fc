"""Tagged documents: tokens, field extents, links and metadata out of markup (a state machine, so Python)."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from urllib.parse import urljoin, urlsplit, urlunsplit

_EVENT = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>[A-Za-z][\w:-]*)(?P<attrs>[^<>]*?)(?P<self>/?)>|&(?P<entity>[A-Za-z#0-9]+);|(?P<word>[^\W_]+(?:'[^\W_]+)*)", re.DOTALL)
_ATTR = re.compile(r"([\w:-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")

#: Tags that never have a closing one.
VOID = {"br", "hr", "img", "meta", "link", "input", "base", "area", "col", "wbr"}


@dataclass
class Markup:
    """What of a document's tags is kept. Conflation maps (tag, attribute, value), or (tag, None, None), to a canonical tag."""

    index: frozenset[str] | None = None  # None: all
    include: frozenset[str] = frozenset()  # only tokens inside these; empty: everywhere
    exclude: frozenset[str] = frozenset({"script", "style"})
    metadata: frozenset[str] = frozenset({"docno", "title"})
    conflate: dict[tuple[str, str | None, str | None], str] = field(default_factory=dict)
    numeric: frozenset[str] = frozenset()
    characters: bool = False  # every letter and digit is a token of its own


def normal_url(url: str, base: str = "") -> str:
    """Absolute, host in lower case, path without dot segments and doubled slashes, no fragment."""
    p = urlsplit(urljoin(base, url.strip()))
    path: list[str] = []
    for part in p.path.split("/"):
        if part == "..":
            path = path[:-1]
        elif part not in ("", "."):
            path.append(part)
    tail = "/" if p.path.endswith(("/", "/.", "/..")) and path else ""
    port = f":{p.port}" if p.port and (p.scheme, p.port) not in (("http", 80), ("https", 443)) else ""
    return urlunsplit((p.scheme.lower(), (p.hostname or "").lower() + port, "/" + "/".join(path) + tail, p.query, ""))


def parse(text: str | None, rules: Markup = Markup(), url: str = "") -> dict:
    """tokens [(term, begin, end)], extents [(field, begin, end, number, ordinal, parent)], metadata and links [(url, begin, end)].

    Positions count tokens; tokens of excluded regions are dropped and later ones move up. Ordinals count
    from 1 in the order of opening, `document` is 1 and wraps all, a parent is the ordinal of the indexed tag around. Tags left open
    end with the tag around them or the text. Metadata tags keep the raw text of their first occurrence.
    """
    text = text or ""
    tokens: list[tuple[str, int, int]] = []
    extents: list[list] = [["document", 0, 0, None, 1, 0]]
    stack: list[tuple[str, int | None, int, str]] = []  # canonical tag, extent index, text offset, tag as written
    meta: dict[str, str] = {}
    links: list[tuple[str, int, int]] = []
    hidden = shown = 0
    base = url

    def close(upto: int, at: int) -> None:
        nonlocal hidden, shown
        while len(stack) > upto:
            name, k, begin, _ = stack.pop()
            if k is not None:
                extents[k][2] = len(tokens)
                if name == "a" and extents[k][3] is not None:
                    links.append((extents[k][3], extents[k][1], len(tokens)))
                    extents[k][3] = None
            hidden -= name in rules.exclude
            shown -= name in rules.include
            if name in rules.metadata:
                meta.setdefault(name, text[begin:at].strip())

    for m in _EVENT.finditer(text):
        if m.group("word"):
            if not hidden and (shown or not rules.include):
                if rules.characters:
                    tokens += [(c.lower(), m.start() + i, m.start() + i + 1) for i, c in enumerate(m.group("word")) if c != "'"]
                    continue
                tokens.append((m.group("word").lower(), m.start(), m.end()))
            continue
        name = written = (m.group("name") or "").lower()
        if not name:
            continue
        attrs = {a.lower(): html.unescape(v.strip("\"'")) for a, v in _ATTR.findall(m.group("attrs") or "")}
        name = rules.conflate.get((name, None, None), name)
        for a, v in attrs.items():
            name = rules.conflate.get((name, a, v), rules.conflate.get((name, a, None), name))
        if m.group("close"):
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][3] == written), None)
            if at is not None:
                close(at, m.start())
            continue
        if name == "base" and attrs.get("href"):
            base = normal_url(attrs["href"], base)
        k = None
        if (rules.index is None or name in rules.index) and name not in VOID and not m.group("self"):
            parent = next((extents[s[1]][4] for s in reversed(stack) if s[1] is not None), 1)
            k = len(extents)
            target = normal_url(attrs["href"], base) if name == "a" and attrs.get("href") else None
            extents.append([name, len(tokens), len(tokens), target, k + 1, parent])
        if name not in VOID and not m.group("self"):
            stack.append((name, k, m.end(), written))
            hidden += name in rules.exclude
            shown += name in rules.include
    close(0, len(text))
    extents[0][2] = len(tokens)
    for e in extents:
        if e[0] in rules.numeric:
            found = re.match(r"-?\d[\d-]*", tokens[e[1]][0]) if e[2] > e[1] else None
            e[3] = int(re.match(r"-?\d+", found.group()).group()) if found else 0
        elif e[3] is not None:
            e[3] = None
    return {"tokens": tokens, "extents": [tuple(e) for e in extents], "metadata": meta, "links": links}


def schema() -> str:
    return (
        "tokens array<struct<term:string,begin:int,end:int>>, extents array<struct<field:string,begin:int,end:int,number:long,ordinal:int,parent:int>>, "
        "metadata map<string,string>, links array<struct<url:string,begin:int,end:int>>"
    )


def rows(texts: Iterable[str | None], urls: Iterable[str | None], rules: Markup) -> list[dict]:
    return [parse(t, rules, u or "") for t, u in zip(texts, urls)]
