"""Quantities recorded in different units, converted to one common unit.

The distinct spellings are few beside the rows, so they are mapped first: each is looked up in an inverted index of
character bigrams over the known unit texts, the candidates are verified with a weighted edit distance, and the
resulting alias dictionary is joined to all rows. Rows without a unit of their own are mapped by the unit written
inside their name text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.session import join_dictionary

#: Weighted edits above which a spelling is not taken for a known unit text.
MAX_COST = 0.75
#: Share of bigrams (Dice) from which a known text becomes a candidate.
MIN_OVERLAP = 0.5
#: Words of a name text that a unit written inside it may span: one more than the longest known text has.
MAX_WORDS = 4
#: Cost of the cheapest edit of a character that is no blank.
CHEAPEST = 0.15

# Known unit texts by (basis, factor). mass factors give ug/L, molar ones umol/L, charge ones ueq/L.
KNOWN: dict[tuple[str, float], str] = {
    ("mg/L", 1e3): "mg/L; mg L-1; ppm; milligram per liter; milligrams per litre; mg/L as CaCO3; mg/L CaCO3; mg l^-1",
    ("mass", 1.0): "ug/L; ug L-1; mcg/L; ppb; microgram per liter; micrograms per litre; mg/m3; mg m-3; ng/mL; ug/dm3",
    ("mass", 1e-3): "ng/L; ng L-1; nanograms per litre",
    ("mass", 1e6): "g/L; g L-1; gram per liter; grams per litre; mg/mL; kg/m3",
    ("mass", 1e4): "mg/dL; mg/100mL; mg/100 ml; milligrams per decilitre",
    ("charge", 1e3): "meq/L; meq L-1; me/L; milliequivalent per liter; milliequivalents per litre; eq/m3",
    ("charge", 1.0): "ueq/L; ueq L-1; microeq/L; microequivalents per litre; meq/m3",
    ("charge", 1e6): "eq/L; equivalents per litre",
    ("molar", 1e3): "mmol/L; mmol L-1; mmole/L; mM; millimole per liter; millimoles per litre; mol/m3; mol/m^3; mol m-3",
    ("molar", 1.0): "umol/L; umol L-1; uM; micromol/L; micromoles per litre; mmol/m3",
    ("molar", 1e6): "mol/L; mol L-1; moles per litre",
    ("none", 0.0): "NTU; FNU; uS/cm; mS/m; mS/cm; deg C; deg F; std units; pH units; none; % sat; %; mg/kg; ug/kg; cfs; m3/s; count; see text; mg; ug; g; ft; m",
}
# The two code points in use for micro.
_MICRO = str.maketrans({"µ": "u", "μ": "u"})


def _plain(text: str) -> str:
    return "".join(text.translate(_MICRO).split()).lower()


def _bigrams(text: str) -> set[str]:
    t = f"^{_plain(text)}$"
    return {t[i : i + 2] for i in range(len(t) - 1)}


def _edit_weight(c: str) -> float:
    """Cost of a missing or extra character: blanks and marks are cheap, plural s is cheap, letters and digits carry the meaning."""
    return 0.05 if c.isspace() else 0.15 if c in "s-_.^()[]*" else 1.0


def weighted_distance(a: str, b: str, most: float = MAX_COST) -> float:
    """Edit distance in which blanks, marks, letter case, plural s and the swapped ending re/er cost little.

    A metric-style dynamic programme over the two texts; stops early with ``most`` + 1 once every path exceeds it.
    """
    a, b = a.translate(_MICRO), b.translate(_MICRO)
    before: list[float] = []
    row = [0.0]
    for y in b:
        row.append(row[-1] + _edit_weight(y))
    for i, x in enumerate(a):
        older, before = before, row
        row = [before[0] + _edit_weight(x)]
        for j, y in enumerate(b):
            change = 0.0 if x == y else 0.02 if x.lower() == y.lower() else 1.0
            best = min(before[j] + change, before[j + 1] + _edit_weight(x), row[j] + _edit_weight(y))
            if i and j and x.lower() == b[j - 1].lower() and y.lower() == a[i - 1].lower() and x.lower() != y.lower():
                best = min(best, older[j - 1] + 0.3)
            row.append(best)
        if min(row) > most:
            return most + 1
    return row[-1]


class UnitIndex:
    """Inverted index from character bigrams to known unit texts."""

    def __init__(self, known: dict[tuple[str, float], str] = KNOWN):
        self.texts = [(alias.strip(), kind, factor) for (kind, factor), line in known.items() for alias in line.split(";")]
        self.grams = [_bigrams(t) for t, _, _ in self.texts]
        self.sizes = [len(_plain(t)) for t, _, _ in self.texts]
        self.index: dict[str, list[int]] = defaultdict(list)
        for k, grams in enumerate(self.grams):
            for g in grams:
                self.index[g].append(k)

    @lru_cache(maxsize=100_000)  # noqa: B019
    def best(self, spelling: str, most: float = MAX_COST) -> tuple[float, str, str, float] | None:
        """(cost, known text, basis, factor) of the cheapest known text within ``most``; ties go to the earlier one.

        Runs of blanks count as one. Texts of any length are looked up: one that is longer than a known text by more
        than ``most`` allows at the cheapest edit is told apart by its length.
        """
        spelling = " ".join(spelling.split())
        grams, size = _bigrams(spelling), len(_plain(spelling))
        shared: dict[int, int] = defaultdict(int)
        for g in grams:
            for k in self.index.get(g, ()):
                shared[k] += 1
        found = None
        for k, n in shared.items():
            if 2 * n < MIN_OVERLAP * (len(grams) + len(self.grams[k])) or abs(size - self.sizes[k]) * CHEAPEST > most:
                continue
            cost = weighted_distance(spelling, self.texts[k][0], most)
            if cost <= most and (found is None or (cost, k) < (found[0], found[4])):
                found = (cost, *self.texts[k], k)
        return found and found[:4]

    def inside(self, text: str) -> tuple[float, str, str, float] | None:
        """The unit written anywhere in a name text: concentrations first, then the longest span of words, then one at an end, then the least cost."""
        words = text.replace("[", " ").replace("]", " ").replace("(", " ").replace(")", " ").split()
        hits = []
        for n in range(1, min(MAX_WORDS, len(words)) + 1):
            for at in range(len(words) - n + 1):
                if hit := self.best(" ".join(words[at : at + n]).strip(" ,;-"), 0.5):
                    hits.append((hit[2] == "none", -n, 0 < at < len(words) - n, hit[0], hit))
        return min(hits)[4] if hits else None


def _mapper(inside: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = UnitIndex()
        look = index.inside if inside else index.best
        for pdf in batches:
            hits = [look(x) for x in pdf["spelling"]]
            yield pd.DataFrame(
                {
                    "spelling": pdf["spelling"],
                    "unit_text": [h and h[1] for h in hits],
                    "basis": [h[2] if h else "none" for h in hits],
                    "factor": [h[3] if h else 0.0 for h in hits],
                    "cost": [h and h[0] for h in hits],
                }
            )

    return run


def alias_dictionary(df: DataFrame, text_col: str, inside: bool = False) -> DataFrame:
    """One row per distinct non-null text: ``spelling, unit_text, basis, factor, cost``.

    ``inside`` looks for the unit within a longer text. ``basis`` is mg/L (already the common unit), mass, charge,
    molar or none; ``unit_text`` and ``cost`` are null where no known text is near enough (basis none).
    """
    texts = df.select(F.col(text_col).alias("spelling")).filter(F.col("spelling").isNotNull()).distinct()
    # Small in bytes but dear in CPU: spread over all cores instead of the few partitions that sizes suggest.
    texts = texts.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)
    return texts.mapInPandas(_mapper(inside), "spelling string, unit_text string, basis string, factor double, cost double")


def stated_units(df: DataFrame, key: str, unit_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the columns of ``carry``, ``unit_text, basis, factor`` of every row: the unit of ``unit_col`` or, where that is null, the one in ``text_col``.

    ``basis`` is none where there is no unit or none of concentration.
    """
    rows = df.select(key, *carry, F.col(unit_col).alias("__u"), F.coalesce(unit_col, text_col).alias("spelling"))
    parts = []
    for inside in (False, True):
        part = rows.filter(F.col("__u").isNull() if inside else F.col("__u").isNotNull())
        parts.append(join_dictionary(part, alias_dictionary(part, "spelling", inside).drop("cost"), ["spelling"], "left"))
    return parts[0].unionByName(parts[1]).select(key, *carry, "unit_text", F.coalesce("basis", F.lit("none")).alias("basis"), "factor")


def to_micrograms(df: DataFrame, ions: DataFrame, key: str, value_col: str, unit_col: str, text_col: str, ion_col: str) -> DataFrame:
    """``key, value_ug, basis, unit_text``: the value in ug/L as a double; null where it is no concentration per volume.

    The unit is that of ``unit_col`` or, where that is null, the one in ``text_col``. Charge and molar units convert by
    ``equiv_weight`` and ``molar_mass`` of the row's ion; an unknown ion gives null there. Null values give null. Every
    input row gives one row; an empty table gives an empty one. Columns beside those named are ignored.
    """
    rows = df.select(F.col(key), F.col(value_col).alias("__v"), F.col(ion_col).alias("__of"), F.col(unit_col).alias("__unit"), F.col(text_col).alias("__text"))
    both = stated_units(rows, key, "__unit", "__text", ("__v", "__of"))
    weights = ions.select(F.col("ion").alias("__ion"), "molar_mass", "equiv_weight")
    both = both.join(weights, F.col("__of") == F.col("__ion"), "left")
    scale = F.when(F.col("basis").isin("mg/L", "mass"), F.lit(1.0)).when(F.col("basis") == "charge", F.col("equiv_weight")).when(F.col("basis") == "molar", F.col("molar_mass"))
    return both.select(key, (F.col("__v") * F.col("factor") * scale).alias("value_ug"), "basis", "unit_text")


def fill_milligrams(df: DataFrame, ions: DataFrame, value_col: str = "value_source", unit_col: str = "unit_source", text_col: str = "characteristic_source", ion_col: str = "ion", out: str = "value_mg_L") -> DataFrame:
    """``df`` with each null ``out`` filled with ``value_col`` in mg/L, by the unit rules of ``to_micrograms``.

    A value without a known concentration unit stays null; values that are there stay as they are. NaN counts as a value.
    """
    spelling = F.coalesce(F.col(unit_col), F.col(text_col))
    rows = df.withColumn("__spelling", F.when(F.col(out).isNull() & F.col(value_col).isNotNull(), spelling)).withColumn("__inside", F.col(unit_col).isNull())
    parts = [alias_dictionary(rows.filter(F.col("__inside") == inside), "__spelling", inside).withColumn("__inside", F.lit(inside)) for inside in (False, True)]
    units = parts[0].unionByName(parts[1]).select(F.col("spelling").alias("__spelling"), "__inside", F.col("basis").alias("__basis"), F.col("factor").alias("__factor"))
    weights = ions.select(F.col("ion").alias("__ion"), F.col("molar_mass").alias("__molar"), F.col("equiv_weight").alias("__equiv"))
    rows = join_dictionary(rows, units, ["__spelling", "__inside"], "left").join(weights, F.col(ion_col) == F.col("__ion"), "left")
    scale = F.when(F.col("__basis").isin("mg/L", "mass"), F.lit(1.0)).when(F.col("__basis") == "charge", F.col("__equiv")).when(F.col("__basis") == "molar", F.col("__molar"))
    filled = F.coalesce(F.col(out), F.col(value_col) * (F.col("__factor") / 1000 * scale))
    return rows.select(*[filled.alias(c) if c == out else F.col(f"`{c}`") for c in df.columns])


def found(df: DataFrame, ions: DataFrame, key: str = "rec_id") -> DataFrame:
    """``rec_id, value_ug`` of the non-null values whose unit is not mg/L in any spelling, rounded to whole ug/L; -1 where it is no concentration."""
    some = df.filter(F.col("value_source").isNotNull() & ~F.isnan("value_source"))
    out = to_micrograms(some, ions, key, "value_source", "unit_source", "characteristic_source", "ion").filter(F.col("basis") != "mg/L")
    return out.select(key, F.coalesce(F.round("value_ug").cast("bigint"), F.lit(-1).cast("bigint")).alias("value_ug"))
