"""Passages of evaluation items in a corpus: template windows, hash-joined, with slots compared."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.llm.bits import bit_filter, in_filter
from lexigrove.llm.words import WORD, mix, runs
from lexigrove.session import BROADCAST_ROWS, materialise

#: Words taken as units of measure (English, German, French, Spanish).
UNITS = (
    "second seconds minute minutes hour hours day days week weeks month months year years "
    "metre metres meter meters kilometre kilometres kilometer kilometers mile miles foot feet inch inches "
    "gram grams kilogram kilograms tonne tonnes pound pounds ounce ounces litre litres liter liters gallon gallons "
    "percent degree degrees euro euros dollar dollars cent cents km kg cm mm "
    "sekunde sekunden minuten stunde stunden tag tage tagen woche wochen monat monate monaten jahr jahre jahren "
    "kilo gramm tonnen prozent grad pfund "
    "seconde secondes heure heures jour jours semaine semaines mois an ans année années mètre mètres kilomètre kilomètres "
    "gramme grammes kilogramme kilogrammes pourcent degré degrés "
    "segundo segundos minuto minutos hora horas día días semana semanas mes meses año años metro metros kilómetro kilómetros "
    "gramo gramos kilogramo kilogramos litro litros tonelada toneladas grado grados"
).split()

#: Placeholders, none of which can be a word.
NUMBER, UNIT, NAME = "<number>", "<unit>", "<name>"

#: Bits of the filter of item windows: about FILTER_LOAD a window, FILTER_BITS (32 MB) at most. With more windows than that
#: the filter lets more corpus windows through to the join, which decides; none is lost.
FILTER_LOAD, FILTER_BITS = 32, 1 << 28

#: Distinct words of the items, 9 bytes each on the driver and in each task. A held-out set with more is refused.
LEXICON_WORDS = 16_000_000

#: Texts cut into windows at a time.
CHUNK_TEXTS = 500

_DIGITS = re.compile(r"\d+")
_START = re.compile(r"(?:^|[.!?:…\n\"“„«»(])[\s\"“„«»(]*\Z")


def _code(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


#: Codes of the placeholders; slots of kind 0 are fixed words.
_KINDS = np.array([0, _code(NUMBER), _code(UNIT), _code(NAME)], np.uint64)


def lexicon(items: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the items' words, and whether each is a name: one that is somewhere written with a capital
    within a sentence and nowhere without. Corpus words of the lexicon are typed by it whatever their case, so that a
    verbatim passage has the template of its item also in capitals."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[str, int] = {}
            for t in b.column(0).to_pylist():
                plain = len(t.lower()) != len(t)  # letters that change length: no capitals are told
                for m in WORD.finditer(t.lower() if plain else t):
                    w, low = m.group(), m.group().lower()
                    lower = w == low
                    inside = not lower and not w.isupper() and not _START.search(t, max(0, m.start() - 8), m.start())
                    seen[low] = seen.get(low, 0) | (1 if lower else 2 if inside else 0)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array([v & 1 for v in seen.values()], pa.int32()), pa.array([v >> 1 for v in seen.values()], pa.int32())], ["w", "lower", "inside"])

    words = items.select("text").mapInArrow(work, "w string, lower int, inside int").groupBy("w").agg(F.max("lower").alias("lower"), F.max("inside").alias("inside"))
    words = materialise(words)
    if words.count() > LEXICON_WORDS:
        raise ValueError(f"the items have more than {LEXICON_WORDS} distinct words")
    rows = words.toPandas()
    codes = np.array([_code(w) for w in rows["w"]], np.uint64)
    names = ((rows["lower"] == 0) & (rows["inside"] == 1)).to_numpy(bool)
    order = np.argsort(codes)
    return codes[order], names[order]


class Canon(dict):
    """word as written -> number of its kind and hashes; tables `kind`, `exact` (hash) and `lower` (word) are by that number."""

    def __init__(self, known: tuple[np.ndarray, np.ndarray], units: frozenset[str]) -> None:
        self.known, self.units = known, units
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.kinds: list[int] = []
        self.codes: list[int] = []
        self.lower: list[str] = []

    def __missing__(self, word: str) -> int:
        low = word.lower()
        code = _code(low)
        keys, names = self.known
        at = int(np.searchsorted(keys, np.uint64(code)))
        known = at < len(keys) and int(keys[at]) == code
        kind = 1 if _DIGITS.fullmatch(low) else 2 if low in self.units else 3 if (names[at] if known else word[0].isupper() and not word.isupper()) else 0
        self.kinds.append(kind)
        self.codes.append(code)
        self.lower.append(low)
        value = self[word] = len(self.kinds) - 1
        return value


def _spans(texts: list[str | None], canon: Canon, size: int, least_fixed: int) -> Iterator[tuple]:
    """Windows of the texts, twice: of `size` words, and of `size` slots where a run of numbers or of names is one slot and
    some such run has several words. Yields (hash, text, first slot, slots' words as numbers of canon, first word of each slot)."""
    lists = [WORD.findall(t if len(t.lower()) == len(t) else t.lower()) if t else [] for t in texts]
    n = sum(map(len, lists))
    ids = np.fromiter((canon[w] for ws in lists for w in ws), np.int64, n)
    lengths = np.array([len(ws) for ws in lists], np.int64)
    kinds, codes = np.array(canon.kinds, np.int64), np.array(canon.codes, np.uint64)
    kind, exact = kinds[ids], codes[ids]
    template = np.where(kind > 0, _KINDS[kind], exact)
    h, text, pos = runs(template, lengths, size)
    start = np.cumsum(lengths) - lengths
    begin = start[text] + pos
    fixed = np.r_[0, np.cumsum(kind == 0)]
    few = fixed[begin + size] - fixed[begin] < least_fixed
    if few.any():  # almost no words of their own: such windows meet by their words only
        h[few] = mix(runs(exact, lengths, size)[0][few] ^ np.uint64(0x5A5A5A5A5A5A5A5A))
    yield h, text, begin, np.arange(n + 1), ids
    owner = np.repeat(np.arange(len(lengths)), lengths)
    joined = np.zeros(n, bool)
    joined[1:] = (kind[1:] == kind[:-1]) & ((kind[1:] == 1) | (kind[1:] == 3)) & (owner[1:] == owner[:-1])
    if not joined.any():
        return
    first = np.flatnonzero(~joined)
    slots = np.bincount(owner[first], minlength=len(lengths)).astype(np.int64)
    h, text, pos = runs(template[first], slots, size)
    begin = (np.cumsum(slots) - slots)[text] + pos
    ends = np.r_[first, n]
    fixed = np.r_[0, np.cumsum(kind[first] == 0)]
    use = (ends[begin + size] - ends[begin] > size) & (fixed[begin + size] - fixed[begin] >= least_fixed)
    yield h[use], text[use], begin[use], ends, ids


def _texts(slots: list[list[int]], canon: Canon, by_words: bool) -> tuple[str, str]:
    """A window's template and its words. In the template every slot has its kind and the number of the first slot with
    the same words, so that equal templates say that the slots map one to one."""
    words = [" ".join(canon.lower[v] for v in g) for g in slots]
    text = "\t".join(words)
    if by_words:
        return text, text
    names: dict[str, int] = {}
    kinds = (None, NUMBER, UNIT, NAME)
    return "\t".join(w if not canon.kinds[g[0]] else f"{kinds[canon.kinds[g[0]]]}{names.setdefault(w, len(names))}" for w, g in zip(words, slots)), text


def _batch(part: pa.RecordBatch, canon: Canon, size: int, least_fixed: int, wanted) -> pa.RecordBatch:
    if len(canon) > 1_000_000:
        canon.reset()
    at, hashes, templates, words = [], [], [], []
    for h, text, begin, ends, ids in _spans(part.column(1).to_pylist(), canon, size, least_fixed):
        if wanted is not None:
            hit = np.flatnonzero(in_filter(wanted, h))
            h, text, begin = h[hit], text[hit], begin[hit]
        at += text.tolist()
        hashes += h.view(np.int64).tolist()
        for b in begin.tolist():
            cut = ends[b : b + size + 1].tolist()
            slots = [ids[x:y].tolist() for x, y in zip(cut, cut[1:])]
            t, w = _texts(slots, canon, sum(not canon.kinds[g[0]] for g in slots) < least_fixed)
            templates.append(t)
            words.append(w)
    return pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array(hashes, pa.int64()), pa.array(templates, pa.string()), pa.array(words, pa.string())], ["id", "h", "template", "words"])


def leaks(docs: DataFrame, items: DataFrame, size: int = 12, least_fixed: int = 4, units: Sequence[str] = tuple(UNITS), filter_bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, item_id, kind, n_windows) for every document that holds a window of `size` words of an item.

    Numbers, units and names become placeholders in both (names by `lexicon`; corpus words that no item has are names if they
    have a capital); windows of equal template are hash-joined and their slots compared:
    kind is `verbatim` if in some window all slots hold equal words, else `reworded` if the slots of a
    window map one to one onto those of the item (a question with other parameters). In a second set of windows a run of
    numbers or names is one slot, so that a value may have more words than the item's. Windows with fewer than least_fixed
    words besides slots are joined by their words alone, and are never `reworded`.
    Words are lower-cased longest runs of letters and digits. NULL texts and texts under `size` words have no window; equal rows and
    equal ids fall together, a NULL id is an id; without documents or items there are no rows; other columns are ignored.

    items is the held-out set. Corpus windows pass a set of bits of the items' windows in the task that cuts them, of one size whatever
    their number; only those that hit are shuffled and joined.
    """
    few = items.select("item_id", "text").dropna(subset=["text"])
    spark, chosen = docs.sparkSession, frozenset(units)
    known = spark.sparkContext.broadcast(lexicon(few))

    def cut(batches: Iterator[pa.RecordBatch], use) -> Iterator[pa.RecordBatch]:
        canon = Canon(known.value, chosen)
        for b in batches:
            for at in range(0, b.num_rows, CHUNK_TEXTS):
                yield _batch(b.slice(at, CHUNK_TEXTS), canon, size, least_fixed, use.value if use else None)

    schema = "id {}, h long, template string, words string"
    of_items = few.mapInArrow(lambda it: cut(it, None), schema.format(dict(items.dtypes)["item_id"]))
    of_items = materialise(of_items.select(F.col("id").alias("item_id"), "h", "template", F.col("words").alias("item_words")).distinct())
    n = of_items.count()
    bits = min(filter_bits, 1 << max(16, (FILTER_LOAD * n).bit_length()))
    wanted = spark.sparkContext.broadcast(bit_filter(of_items, bits))
    of_docs = docs.select("doc_id", "text").dropna(subset=["text"]).mapInArrow(lambda it: cut(it, wanted), schema.format(dict(docs.dtypes)["doc_id"]))
    pairs = of_docs.join(F.broadcast(of_items) if n <= BROADCAST_ROWS else of_items, ["h", "template"])
    out = pairs.groupBy(F.col("id").alias("doc_id"), "item_id").agg(F.max(F.col("words") == F.col("item_words")).alias("same"), F.count("*").alias("n_windows"))
    return out.select("doc_id", "item_id", F.when(F.col("same"), "verbatim").otherwise("reworded").alias("kind"), "n_windows")
