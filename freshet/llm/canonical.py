"""Freely typed values mapped to the entries of a reference list.

The distinct texts are normalised (case, accents, marks, word order, written abbreviations, units) and searched in
BK-trees over the spellings of the reference entries under a true metric, the unrestricted Damerau-Levenshtein
distance. The triangle inequality prunes the trees and every entry within the threshold comes back; the nearest wins. A
list beyond ``SHARD`` spellings is cut into shards, each text visits every shard, and the shards' winners are merged.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.operators.unit_aliases import MAX_WORDS, UnitIndex
from freshet.session import join_dictionary

#: Spellings in one tree; up to this many the list is shipped whole to each task, beyond it sharded.
SHARD = 50_000
#: Edits allowed in a text of at least the given length.
THRESHOLDS = ((12, 3), (5, 2), (3, 1), (0, 0))


@dataclass(frozen=True)
class Terms:
    """What is known of a subject beside its reference list; by default nothing.

    ``abbreviations`` are written out; ``noise`` are words that add nothing to an entry (not at the start of a text);
    ``bare`` are left out even there; ``others`` names, by kind, quantities near the list that win like entries, as unmatched.
    """

    abbreviations: Mapping[str, str] = field(default_factory=dict)
    noise: frozenset[str] = frozenset()
    bare: frozenset[str] = frozenset()
    others: Mapping[str, str] = field(default_factory=dict)


NO_TERMS = Terms()


def distance(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance: insert, delete, replace, swap of neighbours; a metric."""
    if a == b:
        return 0
    if not a or not b:
        return len(a) + len(b)
    far = len(a) + len(b)
    last: dict[str, int] = {}
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, x in enumerate(a, 1):
        match = 0
        row, above = d[i + 1], d[i]
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), match
            if x == y:
                cost, match = 0, j
            else:
                cost = 1
            row[j + 1] = min(above[j] + cost, row[j] + 1, above[j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[x] = i
    return d[-1][-1]


class BKTree:
    """Burkhard-Keller tree: a child hangs at its distance to the parent."""

    def __init__(self, items: list[tuple[str, object]]):
        self.root: list | None = None
        for text, what in items:
            self.add(text, what)

    def add(self, text: str, what: object) -> None:
        if self.root is None:
            self.root = [text, [what], {}]
            return
        node = self.root
        while True:
            k = distance(text, node[0])
            if k == 0:
                node[1].append(what)
                return
            child = node[2].get(k)
            if child is None:
                node[2][k] = [text, [what], {}]
                return
            node = child

    def within(self, text: str, most: int) -> list[tuple[int, str, object]]:
        """Every (distance, spelling, item) within ``most``; a child at distance k is visited only if |k - d| <= most."""
        out, todo = [], [self.root] if self.root else []
        while todo:
            spelling, items, children = todo.pop()
            d = distance(text, spelling)
            if d <= most:
                out += [(d, spelling, x) for x in items]
            todo += [c for k, c in children.items() if d - most <= k <= d + most]
        return out


def fold(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


@lru_cache(maxsize=1)
def _units() -> UnitIndex:
    return UnitIndex()


def without_unit(text: str) -> str:
    """The text without a concentration unit at its end or start, and without the word that introduces it."""
    words = re.sub(r"[()\[\]]", " ", text).split()
    for n in range(min(MAX_WORDS, len(words) - 1), 0, -1):
        for span, rest in ((words[-n:], words[:-n]), (words[:n], words[n:])):
            hit = _units().best(" ".join(span).strip(" ,;-"), 0.5)
            if hit and hit[2] != "none":
                return re.sub(r"[\s,;]*(?:\b(?:in|as)|-)?\s*$", "", " ".join(rest)).strip()
    return text


def normal(text: str, units: bool = False, terms: Terms = NO_TERMS) -> list[str]:
    """Normalised readings of a text: as it stands, and with its abbreviations written out, its words without meaning left out."""
    if units:
        text = without_unit(text)
    words = re.findall(r"[a-z0-9]+", fold(text))
    full = [terms.abbreviations.get(w, w) for w in words]
    kept = [w for k, w in enumerate(full) if not (w in terms.noise and k and len(full) > 1) and not (w.isdigit() and k)] if len(full) > 1 else full
    kept = [w for w in kept if w not in terms.bare] or kept
    out = [" ".join(words), " ".join(full), " ".join(kept)]
    return list(dict.fromkeys(x for x in out if x))


def threshold(text: str) -> int:
    return next(k for size, k in THRESHOLDS if len(text) >= size)


def spellings(entries: list[tuple[int, str, str | None]], kind: str, terms: Terms = NO_TERMS) -> list[tuple[str, int]]:
    """(spelling, entry id) of names and aliases, also with the last word first; other quantities with id 0."""
    out: dict[tuple[str, int], None] = {}
    texts = [(e, t) for e, name, aliases in entries for t in [name, *(aliases or "").split(";")] if t and t.strip()]
    for e, t in [*texts, *((0, x) for x in terms.others.get(kind, "").split(";") if x.strip())]:
        words = re.findall(r"[a-z0-9]+", fold(t))
        out[" ".join(words), e] = None
        if len(words) == 2:
            out[" ".join(words[::-1]), e] = None
    return list(out)


def nearest(tree: BKTree, text: str, units: bool = False, terms: Terms = NO_TERMS) -> tuple[int, int, str] | None:
    """(distance, entry id, spelling) of the nearest entry over all readings of the text; ties go to entries before other quantities, then to the smaller id."""
    best = None
    for reading in normal(text, units, terms):
        for d, s, e in tree.within(reading, min(threshold(reading), best[0] if best else 99)):
            if best is None or (d, e == 0, e, s) < (best[0], best[1] == 0, best[1], best[2]):
                best = (d, e, s)
    return best


def _entries(reference: DataFrame, kind: str) -> tuple[list[tuple[int, str, str | None]], bool]:
    rows = reference.filter(F.col("kind") == kind).filter(F.col("name").isNotNull()).select("ref_id", "name", "aliases")
    some = rows.limit(SHARD + 1).collect()
    return [(r["ref_id"], r["name"], r["aliases"]) for r in some], len(some) > SHARD


_OUT = "text string, ref_id bigint, distance int, spelling string"


def _frame(texts: pd.Series, hits: list[tuple[int, int, str] | None]) -> pd.DataFrame:
    cols = {"text": texts.tolist(), "ref_id": [h[1] if h else 0 for h in hits], "distance": [h and h[0] for h in hits], "spelling": [h and h[2] for h in hits]}
    return pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in cols.items()})


def map_texts(texts: DataFrame, reference: DataFrame, kind: str, units: bool = False, terms: Terms = NO_TERMS) -> DataFrame:
    """``text, ref_id, distance, spelling`` for every row of ``texts`` (one column ``text``, distinct).

    ``ref_id`` is 0, and ``spelling`` the other quantity or null, where the text names nothing on the list. Null texts
    stay null with ref_id 0. ``reference``: ``ref_id, kind, name, aliases`` (parted by ``;``), read for one ``kind``.
    ``units`` leaves out a concentration unit in the text. An empty list leaves every text unmatched.
    """
    entries, many = _entries(reference, kind)
    if many:
        return _map_sharded(texts, reference, kind, units, terms)
    items = spellings(entries, kind, terms)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = BKTree(items)
        for pdf in batches:
            hits = [None if t is None else nearest(tree, t, units, terms) for t in pdf["text"]]
            yield _frame(pdf["text"], hits)

    # Small in bytes but dear in CPU: spread over all cores instead of the few partitions that sizes suggest.
    return texts.select("text").repartition(2 * texts.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, _OUT)


def _map_sharded(texts: DataFrame, reference: DataFrame, kind: str, units: bool, terms: Terms = NO_TERMS) -> DataFrame:
    """Lists too large for one tree: a tree per shard of entries; each text is sent to every shard (texts are distinct, shards few)."""
    rows = reference.filter((F.col("kind") == kind) & F.col("name").isNotNull()).select("ref_id", "name", "aliases")
    shards = max(2, -(-rows.count() // SHARD))
    listed = rows.withColumn("shard", F.pmod(F.xxhash64("ref_id"), F.lit(shards)).cast("int"))
    lots = 16
    listed = listed.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
    asked = texts.select("text").withColumn("lot", F.pmod(F.xxhash64("text"), F.lit(lots)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        tree = BKTree(spellings(list(zip(left["ref_id"], left["name"], left["aliases"])), kind, terms))
        hits = [None if t is None else nearest(tree, t, units, terms) for t in right["text"]]
        return _frame(right["text"], hits)

    found = listed.groupBy("shard", "lot").cogroup(asked.groupBy("shard", "lot")).applyInPandas(run, _OUT)
    best = F.min_by(F.struct("ref_id", "distance", "spelling"), F.struct(F.coalesce("distance", F.lit(99)), F.col("ref_id") == 0, F.col("ref_id"), F.col("spelling")))
    return found.groupBy("text").agg(best.alias("b")).select("text", "b.*")


def map_column(df: DataFrame, reference: DataFrame, key: str, column: str, kind: str, units: bool = False, terms: Terms = NO_TERMS) -> DataFrame:
    """``key, field, ref_id`` for each non-null text of ``column`` that is not letter for letter a name of its kind.

    Each distinct text is mapped once (map-side combined), then the dictionary is joined to all rows, broadcast only
    below a checked size. Extra columns are ignored; repeated rows give repeated results; an empty table gives none.
    """
    rows = df.select(key, F.col(column).alias("text")).filter(F.col("text").isNotNull())
    names = reference.filter(F.col("kind") == kind).select(F.col("name").alias("text"))
    texts = rows.select("text").distinct().join(names, "text", "left_anti")
    mapped = map_texts(texts, reference, kind, units, terms).select("text", "ref_id")
    return join_dictionary(rows, mapped, ["text"]).select(key, F.lit(column).alias("field"), "ref_id")


def found(df: DataFrame, reference: DataFrame, terms: Terms, key: str = "rec_id") -> DataFrame:
    """Each typed name and fraction that is no exact entry, with the entry it stands for, 0 where there is none."""
    names = map_column(df, reference, key, "characteristic_source", "characteristic", units=True, terms=terms)
    return names.unionByName(map_column(df, reference, key, "fraction", "fraction", terms=terms))
