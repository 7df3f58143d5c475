"""Unit spellings with outer blanks."""

from freshet.operators.unit_aliases import UnitIndex


def test_outer_blanks_do_not_count_for_the_length():
    index = UnitIndex()
    assert index.best("mg/L" + " " * 60) == index.best(" " * 70 + "mg/L") == index.best("mg/L") and index.best("mg/L")[2] == "mg/L"
    assert index.best("x" * 61) is None and index.best(" " * 70) is None


def test_units_of_any_length_and_place():
    index = UnitIndex()
    for text, unit in (("Chloride mg/L dissolved filtered", "mg/L"), ("Chloride, micrograms per litre (lab)", "micrograms per litre"), ("Alkalinity milligrams per litre as CaCO3", "milligrams per litre")):
        assert index.inside(text)[1] == unit, text
    assert index.best("mg" + " " * 300 + "/L")[1] == "mg/L" and index.best("mg/L " * 500) is None and index.best("x" * 100_000) is None
    assert index.inside("Chloride dissolved") is None and index.inside("") is None and index.inside("mg/L")[1] == "mg/L"
