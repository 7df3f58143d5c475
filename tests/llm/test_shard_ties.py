"""Ties between entries and other quantities in sharded lists."""

from freshet.llm import canonical
from freshet.llm.water_terms import WATER


def test_ties_go_to_entries_in_shards_too(spark, monkeypatch):
    names = ["Sulfate", "Chloride", "Calcium", "Sodium", "Potassium", "Magnesium"]
    ref = spark.createDataFrame([(k + 1, "characteristic", n, None) for k, n in enumerate(names)], "ref_id long, kind string, name string, aliases string")
    assert canonical.distance("sulfte", "sulfate") == canonical.distance("sulfte", "sulfite") == 1
    texts = spark.createDataFrame([("sulfte",), ("sulfite",), ("zzzz",), (None,)], "text string")
    run = lambda: {r.text: (r.ref_id, r.distance, r.spelling) for r in canonical.map_texts(texts, ref, "characteristic", terms=WATER).collect()}
    whole = run()
    assert whole["sulfte"] == (1, 1, "sulfate") and whole["sulfite"][0] == 0
    monkeypatch.setattr(canonical, "SHARD", 2)
    assert run() == whole
