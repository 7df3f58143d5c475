"""Percentiles, canonical lists, packing, leakage and splitting against brute force and round trips."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from freshet.llm import canonical, leakage, packing, percentiles, splitting, tokens
from freshet.llm.water_terms import WATER

# ---- percentiles ---------------------------------------------------------------------------------------------------


def _rank_value(values, p):
    v = sorted(values)
    return v[max(1, -(-p * len(v) // 100)) - 1]


def _numbers(spark):
    rng = np.random.default_rng(1)
    rows = [("hot", float(x)) for x in np.round(rng.lognormal(2, 1, 3000), 2)] + [("cold", float(x)) for x in rng.normal(0, 5, 200)] + [("one", 3.0), (None, 1.0), (None, 2.0), ("tie", 7.0), ("tie", 7.0), ("tie", 7.0)]
    bad = [("hot", None), ("hot", float("nan")), ("gone", None)]
    return rows, spark.createDataFrame(rows + bad, "g string, v double").selectExpr("*", "1 as n", "2 as value")


def test_percentiles_exact_and_merged(spark):
    rows, df = _numbers(spark)
    groups = {}
    for g, v in rows:
        groups.setdefault(g, []).append(v)
    want = {(g, p): (_rank_value(v, p), len(v)) for g, v in groups.items() for p in (0, 1, 50, 90, 100)}
    state = percentiles.value_counts(df, ["g"], "v")
    got = {(r.g, r.percent): (r.value, r.n) for r in percentiles.percentiles(state, ["g"], [0, 1, 50, 90, 100]).collect()}
    assert got == want
    halves = [percentiles.value_counts(df.filter(c), ["g"], "v") for c in ("v < 5", "v >= 5 and not isnan(v)")]
    merged = percentiles.merge_counts(*halves)
    assert {(r.g, r.percent): (r.value, r.n) for r in percentiles.percentiles(merged, ["g"], [0, 1, 50, 90, 100], bounds=[1.0, 4.0, 4.0, 9.0]).collect()} == want
    assert percentiles.percentiles(state.limit(0), ["g"], [50]).count() == 0
    both = percentiles.percentiles_by(df, {"all": [], "g": ["g"]}, "v", [50])
    assert {(r.grouping, r.g): r.value for r in both.collect()}["all", None] == _rank_value([v for _, v in rows], 50)


def test_percentiles_bounded_error(spark):
    rows, df = _numbers(spark)
    exact = {(r.g, r.percent): r.value for r in percentiles.percentiles(percentiles.value_counts(df, ["g"], "v"), ["g"], [5, 50, 95]).collect()}
    near = {(r.g, r.percent): r.value for r in percentiles.percentiles(percentiles.value_counts(df, ["g"], "v", 0.02), ["g"], [5, 50, 95]).collect()}
    assert exact.keys() == near.keys()
    assert all(abs(near[k] - exact[k]) <= 0.0201 * abs(exact[k]) + 1e-12 for k in exact)


# ---- canonical list ------------------------------------------------------------------------------------------------

ENTRIES = [(1, "characteristic", "Chloride, dissolved", "Cl dissolved; chlorure dissous"), (2, "characteristic", "Chloride, total", "Cl total"), (3, "characteristic", "Chloride", "Cl; chlorure"), (12, "characteristic", "Magnesium", "Mg"), (11, "characteristic", "Magnesium, total", "Mg total"), (16, "characteristic", "Alkalinity, total", None), (20, "characteristic", "Alkalinity, phenolphthalein", "alcalinité à la phénolphtaléine"), (101, "fraction", "dissolved", "filtered; filterable; dissous"), (102, "fraction", "total", "unfiltered; whole water; recoverable; totale"), (103, "fraction", "suspended", "particulate; non-filterable")]
CASES = {
    "Chloride, dissolvd": 1, "DISSOLVED CHLORIDE": 1, "Chloride (dissolved)": 1, "CHLORURE DISSOUS": 1, "Chloride, diss.": 1, "Chlrride,rdissolved": 1, "mg/L chloride, dissolved": 1, "Chloride, dissolved in ug / L": 1,
    "Cloried": 3, "CL": 3, "Chloride ion": 3, "Chloride conc.": 3, "chloride mM": 3, "MG": 12, "MG TOTAL": 11, "Magnesium, total recoverable": 11, "ALCALINITÉ À LA PHÉNOLPHTALÉINE": 20, "Alkalinity TOT": 16,
    "Chlorine, total residual": 0, "Chlorate, dissolved": 0, "Magnesium hardness": 0, "Manganese, total": 0, "test code 3910": 0, "see remark": 0, "": 0, "??": 0, "Alkalinity": 0, "z" * 3000: 0,
}


def _ref(spark):
    return spark.createDataFrame(ENTRIES, "ref_id long, kind string, name string, aliases string")


def test_names(spark):
    texts = spark.createDataFrame([(t,) for t in CASES] + [(None,)], "text string")
    got = {r.text: r.ref_id for r in canonical.map_texts(texts, _ref(spark), "characteristic", True, WATER).collect()}
    assert got.pop(None) == 0 and got == CASES
    assert {r.ref_id for r in canonical.map_texts(texts, _ref(spark).limit(0), "nothing").collect()} == {0}


def test_without_terms_only_the_list_counts(spark):
    texts = spark.createDataFrame([("Chloride, dissolvd",), ("Chloride, diss.",), ("Manganese, total",), ("field blank",)], "text string")
    got = {r.text: (r.ref_id, r.spelling) for r in canonical.map_texts(texts, _ref(spark), "characteristic").collect()}
    assert got["Chloride, dissolvd"][0] == 1 and got["Chloride, diss."][0] != 1 and got["field blank"] == (0, None)


def test_fractions_and_rows(spark):
    want = {"Filtered 0.45": 101, "unfilterd": 102, "whole wtr": 102, "total rec.": 102, "nonfilterable": 103, "susp.": 103, "Suspended solids phase": 103, "lab-filtered": 101, "field blank": 0, "grab": 0, "Supernatant layer": 0}
    rows = [(i, None, t) for i, t in enumerate(want)] + [(90, None, "total"), (91, None, None), (92, "Chloride", "Total")] * 2
    df = spark.createDataFrame(rows, "rec_id long, characteristic_source string, fraction string").selectExpr("*", "1 as text", "2 as ref_id")
    got = sorted((r.rec_id, r.field, r.ref_id) for r in canonical.found(df, _ref(spark), WATER).collect())
    assert got == sorted([(i, "fraction", k) for i, k in enumerate(want.values())] + [(92, "fraction", 102)] * 2)


def test_shards_agree(spark, monkeypatch):
    texts = spark.createDataFrame([(t,) for t in CASES], "text string")
    whole = {r.text: r.ref_id for r in canonical.map_texts(texts, _ref(spark), "characteristic", True, WATER).collect()}
    monkeypatch.setattr(canonical, "SHARD", 3)
    assert {r.text: r.ref_id for r in canonical.map_texts(texts, _ref(spark), "characteristic", True, WATER).collect()} == whole


words = st.text(alphabet="abc", max_size=6)


@settings(max_examples=200, deadline=None)
@given(words, words, words)
def test_distance_is_a_metric(a, b, c):
    d = canonical.distance
    assert d(a, b) == d(b, a) and (d(a, b) == 0) == (a == b) and d(a, c) <= d(a, b) + d(b, c)


@settings(max_examples=100, deadline=None)
@given(st.lists(words, min_size=1, max_size=20), words, st.integers(0, 3))
def test_tree_returns_every_entry_within(items, q, most):
    tree = canonical.BKTree([(w, i) for i, w in enumerate(items)])
    assert sorted((d, i) for d, _, i in tree.within(q, most)) == sorted((canonical.distance(q, w), i) for i, w in enumerate(items) if canonical.distance(q, w) <= most)


# ---- packing -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("parts", [1, 7])
def test_packing(spark, parts):
    rng = random.Random(3)
    sizes = [rng.choice([0, 1, rng.randint(1, 100), rng.randint(1, 40), 250]) for _ in range(1500)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)] + [(9000, None)], "k long, s long").selectExpr("*", "1 as size", "2 as container").repartition(parts)
    rows = packing.pack(df, "k", "s", 100, 8, 2).collect()
    load, seen = {}, {}
    for r in rows:
        load[r.container] = load.get(r.container, 0) + r.size
        seen.setdefault(r.k, []).append((r.part, r.size))
    assert set(seen) == set(range(1500)) and max(load.values()) <= 100
    for k, p in seen.items():
        assert [s for _, s in sorted(p)] == packing.parts_of(sizes[k], 100)
    assert sum(load.values()) == sum(sizes) and sum(load.values()) / (100 * len(load)) > 0.93
    assert packing.pack(df.limit(0), "k", "s", 100).count() == 0


def test_packer_takes_the_fullest_that_fits():
    p = packing.Packer(10, 2)
    assert [p.add(s) for s in (6, 7, 3, 4)] == [0, 1, 1, 0] and p.closed == {0, 1}
    assert [p.add(s) for s in (6, 7, 8)] == [2, 3, 4] and 3 in p.closed


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "two words"), (2, ""), (3, None), (4, "<|endoftext|>"), (5, "two words")], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in packing.token_counts(df).collect()}
    assert got[1] == got[5] == 2 and got[2] == 0 and 3 not in got and got[4] > 1


# ---- leakage -------------------------------------------------------------------------------------------------------


def _brute_leaks(doc, item, n=12):
    a, b = leakage.words_of(doc), leakage.words_of(item)
    return bool({tuple(a[i : i + n]) for i in range(len(a) - n + 1)} & {tuple(b[i : i + n]) for i in range(len(b) - n + 1)})


def test_leaks_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "naïve", "İl", "straße"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 12, 30, 60])))) for i in range(30)]
    docs = []
    for k in range(120):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        if k % 3 == 0:
            src = items[rng.randrange(30)][1].split()
            cut = rng.randrange(max(1, len(src) - 5))
            text[len(text) // 2 : len(text) // 2] = src[cut : cut + rng.choice([11, 12, 13, 40])]
        docs.append((k, rng.choice([" ", ", ", "\n- ", "_"]).join(w.upper() if rng.random() < 0.2 else w for w in text)))
    docs += [(900, None), (901, ""), (902, docs[0][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item", "2 as coverage")
    i = spark.createDataFrame(items + [(99, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.found(d, i).collect()}
    assert got == {(a, b) for a, t in docs if t for b, u in items if _brute_leaks(t, u)} and got
    assert leakage.found(d.limit(0), i).count() == 0 and leakage.found(d, i.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [64, 1 << 20])
def test_a_full_filter_only_costs_time(spark, monkeypatch, bits):
    items = [(k, " ".join(f"a{k}x{j}" for j in range(20))) for k in range(6)]
    d = spark.createDataFrame([(k, "intro " + t + " end") for k, t in items] + [(50, " ".join(f"b{j}" for j in range(500)))] * 2 + [(0, items[0][1])], "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(leakage, "MOST_BITS", bits)
    assert sorted((r.doc_id, r.item_id) for r in leakage.found(d, i).collect()) == [(0, 0)] + [(k, k) for k in range(6)]


def _tiles_plain(doc, item, least):
    """Greedy tiling as it is defined: all longest free common runs of each round, in order of place."""
    free = [[True] * len(doc), [True] * len(item)]
    out = []
    while True:
        best, longest = [], least - 1
        for i in range(len(doc)):
            for j in range(len(item)):
                k = 0
                while i + k < len(doc) and j + k < len(item) and free[0][i + k] and free[1][j + k] and doc[i + k] == item[j + k]:
                    k += 1
                if k > longest:
                    best, longest = [(i, j)], k
                elif k == longest and k >= least:
                    best.append((i, j))
        if not best:
            return out
        for i, j in best:
            if all(free[0][i : i + longest]) and all(free[1][j : j + longest]):
                free[0][i : i + longest] = [False] * longest
                free[1][j : j + longest] = [False] * longest
                out.append((i, j, longest))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40), st.lists(st.sampled_from("abc"), max_size=25))
def test_tiles_against_the_definition(doc, item):
    assert leakage.tiles(doc, item, 3) == _tiles_plain(doc, item, 3)


def test_tiles_catch_reordered_passages():
    item = [f"w{i}" for i in range(40)]
    doc = ["x"] + item[20:40] + ["y"] + item[0:20] + ["z"]
    t = leakage.tiles(doc, item, 12)
    assert sorted(t) == [(1, 20, 20), (22, 0, 20)]
    assert leakage.leak(" ".join(doc), " ".join(item)) == (2, 20, 1.0) and leakage.leak("", "x") is None
    assert leakage.tiles(item[:11], item, 12) == [] and leakage.tiles(["a"] * 30, ["a"] * 15, 12) == [(0, 0, 15), (15, 0, 15)][:1]


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_hashed_words_are_the_words(text):
    low = text.lower()
    h, a, b = leakage.word_hashes(low)
    found = [low[i:j] for i, j in zip(a, b)]
    assert found == leakage.words_of(text)
    assert all((h[i] == h[j]) == (found[i] == found[j]) for i in range(len(found)) for j in range(i))


# ---- splitting -----------------------------------------------------------------------------------------------------


def _check(text, limit, overlap):
    tok = tokens.tokenizer()
    pieces = splitting.cuts(text, limit, overlap)
    raw = text.encode("utf-8", "replace")
    assert pieces[0][0] == 0 and pieces[-1][1] == len(raw)
    whole = b""
    for a, b, n in pieces:
        part = raw[a:b].decode()  # a cut never falls inside a character
        assert a <= len(whole) and tok.count(part) <= limit and (n == tok.count(part) or abs(n - tok.count(part)) <= 6)
        whole += raw[len(whole) :][: b - len(whole)]
    assert whole == raw
    return pieces


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abé€ .,\n\t日😀")), max_size=900), st.sampled_from([0, 4]))
def test_pieces_cover_and_fit(text, overlap):
    _check(text, 40, overlap)


def test_the_overlap_is_the_one_asked_for():
    rng = random.Random(3)
    words = ["chloride", "river", "Sample,", "the", "mg/L", "élevé", "12.5", "station.", "and\n\n", "field\n", "unfiltered;"]
    text = " ".join(rng.choice(words) for _ in range(6000))
    raw, tok = text.encode(), tokens.tokenizer()
    for limit, overlap in ((256, 16), (1024, 64), (100, 1), (64, 31)):
        pieces = splitting.cuts(text, limit, overlap)
        assert [tok.count(raw[b[0] : a[1]].decode()) for a, b in zip(pieces, pieces[1:])] == [overlap] * (len(pieces) - 1)


def test_long_texts():
    _check("x" * 20000, 100, 10)
    _check(" " * 20000, 100, 10)
    _check("日本語" * 3000, 100, 10)
    _check("\n" * 5000 + "word " * 3000, 100, 0)
    assert splitting.cuts("", 10, 1) == [(0, 0, 0)]


def test_cuts_at_the_strongest_boundary():
    text = ("one two three. " * 6 + "\n\n") * 8
    pieces = _check(text, 60, 0)
    assert all(text[:b].endswith("\n\n") or b == len(text) for _, b, _ in pieces)
    plain = "alpha beta. gamma delta, epsilon zeta " * 30
    assert all(plain[:b].rstrip().endswith(".") or b == len(plain) for _, b, _ in _check(plain, 50, 0))


def test_range_maximum_against_scan():
    rng = np.random.default_rng(2)
    v = rng.integers(-1, 6, 70)
    t = splitting.RangeMaximum(v)
    for a in range(70):
        for b in range(a, 70):
            force, at = t.query(a, b)
            assert force == v[a : b + 1].max() and at == max(i for i in range(a, b + 1) if v[i] == force)


def test_split_rows(spark):
    long = "A sentence of some words here. " * 400
    rows = [(1, "short"), (2, long), (3, None), (4, ""), (5, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as piece", "2 as key")
    out = splitting.split_texts(df, limit=256, overlap=16).collect()
    by = {k: sorted((r.piece, r.start_byte, r.end_byte) for r in out if r.doc_id == k) for k in (1, 2, 3, 4, 5)}
    assert len(by[1]) == 1 and not by[3] and not by[4] and by[2] == by[5] and len(by[2]) > 5
    assert all(b[1] < a[2] for a, b in zip(by[2], by[2][1:]))
    assert sorted(r.doc_id for r in splitting.found(df).collect()) == [2, 5]
    assert splitting.split_texts(df.limit(0)).count() == 0
