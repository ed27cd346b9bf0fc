import random

import numpy as np

from lexigrove.llm import boilerplate as B
from lexigrove.llm import tree

FURNITURE = ["Home | News | Sport", "Log in / Register", "Related stories", "Terms of use | Privacy", "All rights reserved."]
SCHEMA = "docno string, file_class string, text string, content string, url string, metadata map<string,string>, lines string, own string, site string"


def page(k, rng, plain):
    title = f"Title {rng.randint(0, 10**6)} of the day"
    body = [" ".join(rng.choice("one two three four five six seven eight nine ten".split()) for _ in range(rng.randint(12, 30))).capitalize() + f" {rng.randint(0, 10**6)}." for _ in range(rng.randint(3, 7))]
    lines = [(f, 0) for f in FURNITURE[:2]] + [(title, 1)] + [(b, 1) for b in body]
    lines[5:5] = [("A short subheading", 1)]
    lines += [(FURNITURE[2], 0)] + [(f"Other tale {rng.randint(0, 10**6)}", 0) for _ in range(3)] + [(f, 0) for f in FURNITURE[3:]]
    tag = lambda x, y: f"<td>{x}</td>" if plain else f"<p>{x}</p>" if y else f'<a href="/x">{x}</a>' if "Other" in x else f'<div class="b1">{x}</div>'
    text = "<html><body>\n" + "\n".join(tag(x, y) for x, y in lines) + "\n</body></html>"
    return (f"d{k:04d}", "trecweb", text, "\n".join(x for x, _ in lines), f"http://site{k % 3}.x/p", {"title": title}, "", "", ""), [i for i, (_, y) in enumerate(lines) if y]


def test_articles_of_pages_without_telling_tags(spark):
    rng = random.Random(1)
    made = [page(k, rng, k % 2 == 0) for k in range(120)]
    df = spark.createDataFrame([r for r, _ in made], SCHEMA)
    got = {}
    for r in B.article_lines(df).collect():
        got.setdefault(r.docno, set()).add(r.line_no)
    tp = fp = fn = 0
    for (r, want) in made:
        g = got.get(r[0], set())
        tp, fp, fn = tp + len(g & set(want)), fp + len(g - set(want)), fn + len(set(want) - g)
    assert tp / (tp + fp) > 0.95 and tp / (tp + fn) > 0.95


def test_link_density_and_labels(spark):
    found, kind = B._blocks('<body><div class="x">one</div><p>some <a href="/">linked words</a> and <b>bold</b></p>\n<li><a>all of it</a></li>left <i>over</i>')
    assert kind == 2 and found == {"one": ("div", True, 0), "some linked words and": ("p", False, 2), "bold": ("b", False, 0), "all of it": ("li", False, 3), "left over": ("", False, 0)}
    assert B._blocks("<body><p>text</p><li>item</li>")[1] == 1 and B._blocks("<td>text</td>")[1] == 0 and B._blocks(None) == ({}, 0)
    numbers, _, own = B.own_features("text\n\nall links here", "<body><p>text</p><a>all links</a> here", None)
    k = B._K
    assert numbers == [0, 2] and own[:, k["linked"]].tolist() == [0, 2] and own[:, k["label"]].tolist() == [1, 0]


def test_labels_of_the_user_decide(spark):
    """A labelled table that calls sentences furniture and all else the article turns the result round."""
    rng = random.Random(2)
    made = [page(k, rng, True) for k in range(60)]
    df = spark.createDataFrame([r for r, _ in made], SCHEMA)
    rows = [(r[0], i, i not in want) for r, want in made[:40] for i, _ in enumerate(r[3].split("\n"))] + [(None, 1, True), ("d0001", None, True), ("d0001", 2, None), ("nowhere", 0, True)]
    labels = spark.createDataFrame(rows, "docno string, line_no int, article boolean")
    got = {(r.docno, r.line_no) for r in B.article_lines(df, labels).collect()}
    want = {(r[0], i) for r, w in made[40:] for i, _ in enumerate(r[3].split("\n")) if i not in w}
    seen = {x for x in got if x[0] in {r[0] for r, _ in made[40:]}}
    assert len(seen & want) > 0.95 * len(want) and len(seen & want) > 0.95 * len(seen)


def test_odd_input(spark):
    long = " ".join(["word"] * 20) + "."
    rows = [
        ("a", "trecweb", None, f"\n\n{long}\n  \n{long} More.", "http://s/x", None, "", "", ""),
        ("a", "trecweb", f"<p>{long}</p>", f"\n\n{long}\n  \n{long} More.", "http://s/x", None, "", "", ""),
        ("b", "trecweb", "x", None, None, None, "", "", ""),
        ("c", "trecweb", "x", "", None, None, "", "", ""),
        ("d", "trectext", "x", long, None, None, "", "", ""),
        (None, "trecweb", "x", long, None, None, "", "", ""),
        ("e", None, "x", long, None, None, "", "", ""),
        ("f", "trecweb", "<p>" * 50_000, f"{long}\n" * 20_000 + "x" * 1_000_000, None, {}, "", "", ""),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in B.article_lines(df).collect():
        got.setdefault(r.docno, []).append(r.line_no)
    assert set(got) <= {"a", "f"} and sorted(got["a"]) == [2, 4] and len(got["f"]) == len(set(got["f"]))
    assert B.article_lines(df.limit(0)).count() == 0


def test_tree():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5)).astype(np.float32)
    y = ((x[:, 1] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    grown = tree.grow(x[:2000], y[:2000])
    assert ((tree.apply(grown, x[2000:]) > 0.5) == (y[2000:] > 0.5)).mean() > 0.95
    assert tree.apply(tree.grow(x[:1], y[:1]), x[:3]).shape == (3,)
