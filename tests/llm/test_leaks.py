import random

from lexigrove.llm import leaks as L
from lexigrove.llm.words import words

ITEM = "When the Zorund mill closed, 823 families of Nydix moved toward Drol before the long winter came"


def found(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string, h long, ws string")
    i = spark.createDataFrame(items, "item_id long, text string, lang string")
    return {(r.doc_id, r.item_id): r.kind for r in L.leaks(d, i, **kw).collect()}


def row(k, t):
    return (k, t, "x", 1, "y")


def test_verbatim_against_brute_force(spark):
    rng = random.Random(1)
    vocab = ["the", "of", "and", "a", "red", "mill", "house", "Zor", "Vim", "12", "77", "hours"] + [f"w{i}" for i in range(30)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(8, 40))), "en") for k in range(30)]
    docs = []
    for k in range(150):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.5:
            src = rng.choice(items)[1].split()
            a = rng.randrange(len(src))
            cut = src[a : a + rng.randint(9, 15)]
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() if rng.random() < 0.2 else x for x in cut]
        docs.append(row(k, ", ".join(w)))
    want = set()
    for k, t, *_ in docs:
        w = words(t)
        grams = {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
        for j, it, _ in items:
            v = words(it)
            if any(tuple(v[i : i + 12]) in grams for i in range(len(v) - 11)):
                want.add((k, j))
    assert want
    for bits in (L.FILTER_BITS, 64):  # however many windows the filter lets through
        got = found(spark, docs, items, filter_bits=bits)
        assert {k for k, v in got.items() if v == "verbatim"} == want


def test_reworded_questions(spark):
    item = " ".join(ITEM.split()[:12])
    other = item.replace("823", "17").replace("Zorund", "Pelka").replace("Nydix", "Marr").replace("Drol", "Oss")
    mixed = item.replace("Zorund", "Marr").replace("Nydix", "Marr")
    got = found(spark, [row(1, item), row(2, other), row(3, mixed), row(4, other.replace("closed", "opened"))], [(7, item + " when the mill", "en")])
    assert got == {(1, 7): "verbatim", (2, 7): "reworded"}


def test_values_of_several_words(spark):
    other = ITEM.replace("823", "1,250").replace("Nydix", "New Marr Hill").replace("Zorund", "Pelka").replace("Drol", "Oss")
    lower = other.replace("New Marr Hill", "new marr hill")
    got = found(spark, [row(1, other), row(2, lower), row(3, ITEM.upper())], [(7, ITEM, "en")])
    assert got == {(1, 7): "reworded", (3, 7): "verbatim"}


def test_lexicon_and_units(spark):
    items = spark.createDataFrame([("The Zor runs. Mill hands say the Vim of Ost ran 5 Hours. The ost",), ("ÉTÉ",)], "text string")
    codes, names = L.lexicon(items)
    named = {int(c) for c, n in zip(codes, names) if n}
    assert named == {L._code("zor"), L._code("vim"), L._code("hours")} and len(codes) == len(set("the zor runs mill hands say vim of ost ran 5 hours été".split()))
    item = "they walked for 5 hours and then they slept a long while there"
    docs = [row(1, item.replace("5 hours", "7 moons")), row(2, item.replace("5 hours", "7 tage"))]
    assert found(spark, docs, [(7, item, "en")]) == {(2, 7): "reworded"}
    assert found(spark, docs, [(7, item, "en")], units=["moons", "hours"]) == {(1, 7): "reworded"}


def test_odd_input(spark):
    docs = [row(1, None), row(2, ""), row(None, ITEM), row(3, ITEM), row(3, ITEM), row(4, "word " * 400_000 + ITEM)]
    got = found(spark, docs, [(7, ITEM, "en"), (8, None, None), (9, "short", "en"), (None, ITEM, "en"), (7, ITEM, "en")])
    assert set(got) == {(d, i) for d in (None, 3, 4) for i in (7, None)} and set(got.values()) == {"verbatim"}
    assert found(spark, [], [(7, ITEM, "en")]) == {} and found(spark, docs, []) == {}


def slots(text, canon, joined):
    """(kind, words) of each slot of a text, runs of numbers and of names as one slot if joined; naive."""
    import re

    out = []
    for w in re.findall(r"[^\W_]+", text):
        k = canon.kinds[canon[w]]
        if joined and out and k in (1, 3) and out[-1][0] == k:
            out[-1] = (k, out[-1][1] + " " + w.lower())
        else:
            out.append((k, w.lower()))
    return out


def meets(a, b, least_fixed):
    """Whether two windows are equal, or have equal templates of enough words and slots that map one to one."""
    if [w for _, w in a] == [w for _, w in b]:
        return "verbatim"
    if [k for k, _ in a] != [k for k, _ in b] or sum(k == 0 for k, _ in a) < least_fixed or any(k == 0 and x != y for (k, x), (_, y) in zip(a, b)):
        return None
    pairs = {(x, y) for (k, x), (_, y) in zip(a, b) if k}
    # Slots of two kinds may hold equal words only together.
    return "reworded" if len({x for x, _ in pairs}) == len(pairs) == len({y for _, y in pairs}) else None


def test_reworded_against_brute_force(spark):
    rng = random.Random(7)
    names, numbers, fixed = ["Zor", "Vim", "Ost Hill", "Pel", "Marr"], ["12", "7", "1,250", "44"], "the mill of and closed moved old toward".split()

    def fill(pattern):
        return " ".join(rng.choice(names) if x == "N" else rng.choice(numbers) if x == "9" else x for x in pattern)

    patterns = [[rng.choice(fixed + ["N", "9"]) for _ in range(12)] for _ in range(12)]
    items = [(k, "so " + fill(p) + " it", "en") for k, p in enumerate(patterns)]
    docs = [row(k, "and " + fill(rng.choice(patterns)) + " was " + fill(rng.choice(patterns))) for k in range(60)]
    size, least = 8, 3
    known = L.lexicon(spark.createDataFrame(items, "item_id long, text string, lang string"))
    canon = L.Canon(known, frozenset(L.UNITS))
    want = {}
    for d, text, *_ in docs:
        for i, item, _ in items:
            for joined_d in (False, True):
                for joined_i in (False, True):
                    a, b = slots(text, canon, joined_d), slots(item, canon, joined_i)
                    for x in range(len(a) - size + 1):
                        for y in range(len(b) - size + 1):
                            kind = meets(a[x : x + size], b[y : y + size], least)
                            if kind and not (kind == "reworded" and want.get((d, i)) == "verbatim"):
                                if kind == "verbatim" and any(" " in w for _, w in a[x : x + size]) and joined_d != joined_i:
                                    continue
                                want[(d, i)] = kind
    got = found(spark, docs, items, size=size, least_fixed=least)
    assert got == want and {"verbatim", "reworded"} == set(want.values())
