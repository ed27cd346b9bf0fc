"""The article of a web page: flat text blocks, their neighbours, and a decision tree."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.llm import tree
from lexigrove.llm.words import WORD
from lexigrove.session import materialise, skew_safe_lookup

#: Pages of each kind of markup that the labelled table is made of, at most.
LABELLED_PAGES = 1500

#: Tags that hold prose, tags that frame a page, and tags within a line.
PROSE_TAGS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote"}
FRAME_TAGS = {"footer", "nav", "aside", "header", "form"}
INLINE_TAGS = {"a", "i", "em", "strong", "span", "u", "small", "sup", "sub"}

#: Features of a line by itself, in the order in which they are packed as 16-bit numbers; first, second and last are hashes of those words.
OWN = ["words", "chars", "sentence", "quote", "bars", "dash", "digits", "capitals", "title", "in_title", "bullet", "linked", "prose", "frame", "first", "second", "last", "kind", "label"]
_K = {name: i for i, name in enumerate(OWN)}
_PLAIN = _K["first"]  # features up to here are used as they are
_TAGS = [_K["linked"], _K["prose"], _K["frame"]]

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)([^<>]*)>|\n")
_BULLET = re.compile(r"^[\s•*·–-]+\s+")


def _clean(line: str) -> str:
    return _BULLET.sub("", line.strip())


def _blocks(text: str | None) -> tuple[dict[str, tuple[str, bool, int]], int]:
    """(line of text -> tag around it, whether the tag has a class, its words in links; what the page's markup tells).

    Lines end at line ends and at tags that aren't inline. Markup tells furniture from article if there are prose tags: 2 with
    classed frames and links as well, so that list entries belong to the article; else 1, and list entries may be either.
    """
    if not text:
        return {}, 0
    body = text[max(text.find("<body"), 0) :]
    found: dict[str, tuple[str, bool, int]] = {}
    classed = any_link = prose = False
    tag, marked, link, parts, linked, at = "", False, 0, [], 0, 0

    def flush() -> None:
        nonlocal parts, linked
        line = _clean("".join(parts))
        if line:
            found.setdefault(line, ("a" if linked and not tag else tag, marked, linked))
        parts, linked = [], 0

    for m in _TAG.finditer(body):
        piece = body[at : m.start()]
        at = m.end()
        if piece:
            parts.append(piece)
            if link:
                linked += len(WORD.findall(piece))
        name = (m.group(2) or "").lower()
        if name in INLINE_TAGS:
            if name == "a":
                link = 0 if m.group(1) else 1
                any_link |= not m.group(1)
            continue
        flush()
        if not name:
            continue
        if m.group(1):
            tag, marked = "", False
        else:
            tag, marked = name, name not in PROSE_TAGS and "class=" in m.group(3)
            classed |= marked
            prose |= name == "p"
        link = 0
    parts.append(body[at:])
    flush()
    return found, (2 if classed and any_link else 1) if prose else 0


def _word_hash(word: str) -> int:
    return (xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) & 0xFFFF) - 0x8000


def own_features(content: str, text: str | None, title: str | None) -> tuple[list[int], list[int], np.ndarray]:
    """Of each line that isn't blank: its number, the hash of its wording, and its own features.

    The label is 1 for article and 0 for furniture where the page's markup tells (lines of links, frames and classed tags against
    prose tags, and list entries on pages of kind 2), and -1 elsewhere.
    """
    found, kind = _blocks(text)
    title = (title or "").strip().lower()
    numbers, hashes, rows = [], [], []
    for k, line in enumerate(content.split("\n")):
        s = _clean(line)
        if not s:
            continue
        w = WORD.findall(s)
        n, low = len(w), s.lower()
        tag, marked, linked = found.get(s, ("", False, 0))
        label = -1
        if kind and tag:
            furniture = marked or tag in FRAME_TAGS or 2 * linked > n
            label = 0 if furniture else 1 if tag in PROSE_TAGS or (tag == "li" and kind == 2) else -1 if tag == "li" else 0
        numbers.append(k)
        hashes.append(xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63))
        ends = [("#" if x.isdigit() else x.lower()) for x in (*w[:2], *w[-1:])]
        rows.append(
            (
                min(n, 1000),
                min(len(s), 30000),
                s[-1] in ".!?…”\"»)" and n > 3,
                s[0] in "“\"„«»",
                min(s.count("|") + s.count("·") + s.count("»") + s.count("  "), 100),
                min(len(WORD.findall(s[: s.index(" – ")])), 100) + 1 if " – " in s else 0,
                min(sum(x.isdigit() for x in w), 100),
                100 * sum(x[:1].isupper() for x in w) // n if n else 0,
                len(title) > 3 and (title == low or title.startswith((low + " –", low + " -", low + " |"))),
                len(title) > 8 and title[:9] in low,
                line.strip() != s,
                min(linked, 1000),
                tag in PROSE_TAGS,
                tag in FRAME_TAGS or marked or tag == "a",
                _word_hash(ends[0] if n > 1 else "=" + ends[0]) if n else 0,  # a word alone isn't the beginning of a line
                _word_hash(ends[1]) if n > 1 else 0,
                _word_hash(ends[-1]) if n > 1 else 0,
                kind,
                label,
            )
        )
    return numbers, hashes, np.array(rows, np.int16).reshape(-1, len(OWN))


def pages(docs: DataFrame) -> DataFrame:
    """(docno, site, lines, hashes, own), written: one row for each docno with content; of several deliveries one with text goes first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docnos, sites, contents, texts, titles = (c.to_pylist() for c in b.columns)
            made = [own_features(c, t, h) for c, t, h in zip(contents, texts, titles)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(docnos, pa.string()),
                    pa.array([t is not None for t in texts]),
                    pa.array(sites, pa.string()),
                    pa.array([m[0] for m in made], pa.list_(pa.int32())),
                    pa.array([m[1] for m in made], pa.list_(pa.int64())),
                    pa.array([m[2].tobytes() for m in made], pa.binary()),
                ],
                ["docno", "has", "site", "lines", "hashes", "own"],
            )

    site = F.coalesce(F.regexp_extract("url", r"^[A-Za-z]+://([^/:]+)", 1), F.lit(""))
    rows = docs.filter("file_class = 'trecweb' and content is not null and docno is not null").select("docno", site.alias("site"), "content", "text", F.element_at("metadata", "title").alias("title"))
    rows = rows.mapInArrow(work, "docno string, has boolean, site string, lines array<int>, hashes array<long>, own binary")
    best = rows.groupBy("docno").agg(F.max(F.struct("has", "site", "lines", "hashes", "own")).alias("x"))
    return materialise(best.select("docno", "x.site", "x.lines", "x.hashes", "x.own"))


def with_counts(made: DataFrame) -> DataFrame:
    """pages with `at`, `on_site` and `overall`: of the lines that occur on other pages, their index, pages of the site and all pages that have them."""
    lines = made.select("docno", "site", F.posexplode("hashes").alias("at", "h"))
    on_site = materialise(lines.groupBy("site", "h").agg(F.count("*").alias("s")))
    overall = on_site.groupBy("h").agg(F.sum("s").alias("o")).filter("o > 1")
    counts = materialise(on_site.join(overall, "h"))
    total = counts.agg(F.coalesce(F.sum("s"), F.lit(0))).first()[0]
    joined = skew_safe_lookup(lines, counts, ["site", "h"], "s", total).groupBy("docno").agg(F.collect_list(F.struct("at", "s", "o")).alias("c"))
    return made.join(joined, "docno", "left").select("docno", "lines", "own", F.col("c.at").alias("at"), F.col("c.s").alias("on_site"), F.col("c.o").alias("overall"))


def style_tables(own: np.ndarray, y: np.ndarray) -> np.ndarray:
    """counts[position, label, word]: how often short lines of each label begin, go on and end with a word; y is -1 for lines that don't count."""
    counts = np.zeros((3, 2, 1 << 16), np.float32)
    short = own[:, _K["sentence"]] == 0
    for j in range(3):
        words = own[:, _K["first"] + j].astype(np.int64) + 0x8000
        for label in (0, 1):
            counts[j, label] = np.bincount(words[short & (y == label)], minlength=1 << 16)
    return counts


def styles(own: np.ndarray, counts: np.ndarray, y: np.ndarray | None = None) -> np.ndarray:
    """Log odds of `article` by the first, second and last word of each line, and their sum; with y, a line's own label doesn't count."""
    short = own[:, _K["sentence"]] == 0
    out = []
    for j in range(3):
        words = own[:, _K["first"] + j].astype(np.int64) + 0x8000
        no, yes = counts[j, 0][words], counts[j, 1][words]
        if y is not None:
            no, yes = no - (short & (y == 0)), yes - (short & (y == 1))
        out.append(np.log((yes + 1) / (no + 1)))
    return np.stack([*out, sum(out)], axis=1)


def features(own: np.ndarray, lengths: np.ndarray, on_site: np.ndarray, overall: np.ndarray, style: np.ndarray) -> np.ndarray:
    """The tree's features of lines of several pages, one page after the other: own features and style, link density, how often the line
    recurs, and the same of two neighbours on each side, of the run of short lines around it and of the page."""
    n = len(own)
    if not n:
        return np.zeros((0, 1), np.float32)
    page = np.repeat(np.arange(len(lengths)), lengths)
    first = np.repeat(np.cumsum(lengths) - lengths, lengths)
    last = np.repeat(np.cumsum(lengths) - 1, lengths)
    i = np.arange(n)
    most = np.ones(len(lengths))
    np.maximum.at(most, page, on_site)
    share = on_site / most[page]
    often = np.log2(overall)
    again = (on_site >= 3) & (share >= 0.01)
    words, linked = own[:, _K["words"]].astype(np.float64), own[:, _K["linked"]].astype(np.float64)
    density = linked / np.maximum(words, 1)
    before, after = runs_around(own, lengths)

    def between(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sum of values from a up to b, b left out."""
        c = np.r_[0, np.cumsum(values)]
        return c[np.maximum(b, a)] - c[a]

    long = _long(own)
    recent = np.maximum(np.maximum.accumulate(np.where(again, i, -1)), before)
    head = np.maximum.accumulate(np.where(own[:, _K["title"]] > 0, i, -1))
    size = (last - first + 1).astype(np.float32)
    lo, hi = np.maximum(i - 2, first), np.minimum(i + 3, last + 1)
    run = np.maximum(after - before - 1, 1)
    own_columns = [
        i - before - 1,
        after - i - 1,
        after - before - 1,
        between(again, before + 1, i),
        between(again, i + 1, after),
        i - recent,
        before < first,
        after > last,
        (i - first) / size,
        between(long, first, i),
        between(long, i + 1, last + 1),
        np.where(head >= first, np.minimum(i - head, 50), -1),
        between(own[:, _K["prose"]], first, last + 1) / size,
        density,
        between(linked, lo, hi) / np.maximum(between(words, lo, hi), 1),
        between(linked, before + 1, after) / np.maximum(between(words, before + 1, after), 1),
        between(linked, first, last + 1) / np.maximum(between(words, first, last + 1), 1),
        between(style[:, 3], before + 1, after) / run,
        between(own[:, _K["bullet"]], before + 1, after) / run,
    ]
    out = [own[:, :_PLAIN].astype(np.float32), style, share[:, None], often[:, None], again[:, None], on_site[:, None] > 1, np.stack(own_columns, axis=1)]
    for d in (-2, -1, 1, 2):
        j = i + d
        inside = (j >= first) & (j <= last)
        j = np.clip(j, 0, n - 1)
        near = np.stack([words[j], own[j, _K["sentence"]], often[j], share[j], density[j], own[j, _K["prose"]], own[j, _K["bars"]], own[j, _K["title"]], again[j], style[j, 3]], axis=1)
        out.append(np.where(inside[:, None], near, -1))
    return np.concatenate([np.asarray(v, np.float32) for v in out], axis=1)


def _long(own: np.ndarray) -> np.ndarray:
    return (own[:, _K["sentence"]] > 0) & (own[:, _K["words"]] >= 8)


def runs_around(own: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each line the long line before and the one after it on its page (or the place before the first and after the last line)."""
    n = len(own)
    first = np.repeat(np.cumsum(lengths) - lengths, lengths)
    last = np.repeat(np.cumsum(lengths) - 1, lengths)
    i, long = np.arange(n), _long(own)
    before = np.maximum.accumulate(np.where(long, i, -1))
    before = np.where(long, np.r_[-1, before[:-1]], before)
    after = np.minimum.accumulate(np.where(long, i, n)[::-1])[::-1]
    after = np.where(long, np.r_[after[1:], n], after)
    return np.maximum(before, first - 1), np.minimum(after, last + 1)


def with_votes(x: np.ndarray, p: np.ndarray, own: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """x with what a first tree says of the line, its neighbours and the run of short lines around it, so that lines of one block are decided together."""
    if not len(own):
        return x
    first = np.repeat(np.cumsum(lengths) - lengths, lengths)
    last = np.repeat(np.cumsum(lengths) - 1, lengths)
    i = np.arange(len(own))
    before, after = runs_around(own, lengths)
    sums = np.r_[0, np.cumsum(p)]
    run = (sums[np.maximum(after, before + 1)] - sums[before + 1]) / np.maximum(after - before - 1, 1)
    near = [np.where((i + d >= first) & (i + d <= last), p[np.clip(i + d, 0, len(p) - 1)], -1) for d in (-2, -1, 1, 2)]
    return np.concatenate([x, np.stack([p, run, *near], axis=1).astype(np.float32)], axis=1)


def _flat(own: list[bytes], at: list, on_site: list, overall: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    mats = [np.frombuffer(x, np.int16).reshape(-1, len(OWN)) for x in own]
    lengths = np.array([len(m) for m in mats], np.int64)
    start = np.cumsum(lengths) - lengths
    s, o = np.ones(int(lengths.sum())), np.ones(int(lengths.sum()))
    for k, (a, x, y) in enumerate(zip(at, on_site, overall)):
        if a is not None and len(a):
            s[start[k] + np.asarray(a)], o[start[k] + np.asarray(a)] = x, y
    return (np.concatenate(mats) if mats else np.zeros((0, len(OWN)), np.int16)), lengths, s, o


def markup_labels(made: DataFrame, limit: int = LABELLED_PAGES) -> DataFrame:
    """A labelled table (docno, line_no, article) of at most `limit` pages of each kind of markup that tells, taken in the order of a hash of docno; where
    nobody has labelled pages by hand, their markup does."""
    kind = F.substring("own", 2 * _K["kind"] + 1, 1)  # of the first line, as of all
    parts = [made.filter((F.length("own") > 0) & (kind == F.lit(bytes([k])))).orderBy(F.xxhash64("docno"), "docno").limit(limit) for k in (1, 2)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for docno, lines, own in zip(*(c.to_pylist() for c in b.columns)):
                y = np.frombuffer(own, np.int16).reshape(-1, len(OWN))[:, _K["label"]]
                known = np.flatnonzero(y >= 0)
                yield pa.RecordBatch.from_arrays([pa.array([docno] * len(known), pa.string()), pa.array(np.array(lines, np.int32)[known]), pa.array(y[known] > 0)], ["docno", "line_no", "article"])

    return parts[0].unionByName(parts[1]).select("docno", "lines", "own").mapInArrow(work, "docno string, line_no int, article boolean")


def train(counted: DataFrame, labels: DataFrame, most: int = 2 * LABELLED_PAGES):
    """(style tables, tree, second tree) from the labelled lines of at most `most` pages, taken in the order of a hash of docno.

    Every page counts twice, with its tags and with them hidden, as they are on pages laid out by tables or
    plain blocks. The second tree sees what the first says of lines nearby, which for training two trees say of the half of the pages that they
    haven't seen. Without fifty labelled lines the tree is one split: lines of ten words or more that end a sentence.
    """
    marks = labels.filter("docno is not null and line_no is not null and article is not null").groupBy("docno", "line_no").agg(F.max(F.col("article").cast("int")).alias("y"))
    marks = materialise(marks.groupBy("docno").agg(F.collect_list(F.struct("line_no", "y")).alias("marks")).orderBy(F.xxhash64("docno"), "docno").limit(most))
    rows = counted.join(F.broadcast(marks), "docno").orderBy(F.xxhash64("docno"), "docno").select("own", "at", "on_site", "overall", "lines", "marks").collect()  # at most `most` pages
    own, lengths, s, o = _flat([bytes(r[0]) for r in rows], *[[r[k] for r in rows] for k in (1, 2, 3)])
    y = np.full(len(own), -1, np.int64)
    for begin, r in zip(np.cumsum(lengths) - lengths, rows):
        place = {line: k for k, line in enumerate(r["lines"])}
        for mark in r["marks"]:
            if mark["line_no"] in place:
                y[begin + place[mark["line_no"]]] = mark["y"]
    known = y >= 0
    if known.sum() < 50:
        plain = np.array([_K["words"], -1, -1]), np.array([9.5, 0, 0]), np.array([1, -1, -1]), np.array([2, -1, -1]), np.array([0.5, 0.0, 1.0])
        return np.zeros((3, 2, 1 << 16), np.float32), plain, None
    counts = style_tables(own, y)
    style = styles(own, counts, y)
    hidden = own.copy()
    hidden[:, _TAGS] = 0
    half = (np.repeat(np.arange(len(lengths)), lengths) % 2).astype(bool)
    shown, second = [], []
    for version in (own, hidden):
        shown.append(features(version, lengths, s, o, style))
    folds = [tree.grow(np.concatenate([x[known & side] for x in shown]), np.tile(y[known & side].astype(np.float64), 2)) for side in (half, ~half)]
    for x, version in zip(shown, (own, hidden)):
        p = np.where(half, tree.apply(folds[1], x), tree.apply(folds[0], x))
        second.append(with_votes(x, p, version, lengths)[known])
    target = np.tile(y[known].astype(np.float64), 2)
    return counts, tree.grow(np.concatenate([x[known] for x in shown]), target), tree.grow(np.concatenate(second), target)


def article_lines(docs: DataFrame, labels: DataFrame | None = None, limit: int = LABELLED_PAGES) -> DataFrame:
    """(docno, line_no): the lines of content that belong to the article, numbered from 0, each docno once.

    Lines are flat text blocks with their word count, link density, tags (where text gives them), how often the line
    recurs on the site and elsewhere, and the same of their neighbours; a decision tree grown from the labelled table labels(docno, line_no,
    article) - by default markup_labels, of at most 2 x limit pages - decides, and a second one with its votes on nearby lines.
    Only rows of class trecweb with content count; blank lines, empty content and NULL docnos
    give no rows; NULL text, metadata and url only leave their features empty; repeated rows count once; an empty table gives none.
    """
    made = pages(docs)
    counted = materialise(with_counts(made))
    grown = train(counted, markup_labels(made, limit) if labels is None else labels, 2 * limit)
    shared = docs.sparkSession.sparkContext.broadcast(grown)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, one, two = shared.value
        for b in batches:
            for k in range(0, b.num_rows, 500):
                docnos, lines, own, at, s, o = (c.to_pylist() for c in b.slice(k, 500).columns)
                own, lengths, s, o = _flat(own, at, s, o)
                x = features(own, lengths, s, o, styles(own, counts))
                p = tree.apply(one, x)
                yes = (p if two is None else tree.apply(two, with_votes(x, p, own, lengths))) > 0.5
                page = np.repeat(np.arange(len(lengths)), lengths)[yes]
                numbers = np.array([v for ls in lines for v in ls], np.int32)[yes]
                yield pa.RecordBatch.from_arrays([pa.array(docnos, pa.string()).take(pa.array(page)), pa.array(numbers, pa.int32())], ["docno", "line_no"])

    return counted.mapInArrow(work, "docno string, line_no int")
