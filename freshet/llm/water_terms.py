"""Terms of water analysis for mapping names to a reference list (see ``canonical.Terms``)."""

from __future__ import annotations

from freshet.llm.canonical import Terms

# Written-out forms of the abbreviations in use.
_ABBREVIATIONS = {
    "diss": "dissolved", "tot": "total", "filt": "filtered", "unfilt": "unfiltered", "susp": "suspended", "part": "particulate",
    "recov": "recoverable", "rec": "recoverable", "unk": "unknown", "wtr": "water", "resid": "residual", "ads": "adsorption",
    "bicarb": "bicarbonate", "carb": "carbonate", "phenolphth": "phenolphthalein",
}
# Words that add nothing to the meaning of an entry.
_NOISE = {"ion", "any", "conc", "concentration", "phth", "endpoint", "recoverable", "lab", "field", "matter", "solids", "phase", "in", "as", "na", "cl", "ca", "mg", "so4"}
# Other quantities of water analysis that lie near the entries, by kind. They win like entries, as unmatched.
_OTHERS = {
    "characteristic": """chlorine; chlorine residual; chlorine total residual; chlorine free; chlorate; chlorite; perchlorate; chlordane; chlorophyll a; chlorophyll; chloroform;
        sulfite; sulphite; sulfide; sulphide; sulfur; sulphur; sulfide total; sulfur total; sulfite total; sulfide dissolved; sulfur dissolved; chlorate dissolved; chlorite dissolved;
        sodium adsorption ratio; sodium percent of cations; sodium percent; calcium hardness; calcium hardness as caco3; calcium carbonate; magnesium hardness; hardness; hardness total; durete totale;
        manganese; manganese total; manganese dissolved; cadmium; cadmium total; cadmium dissolved; cesium; cesium dissolved; cesium total; potassium; potassium dissolved; potassium total;
        acidity; acidity total; bromide; bromide dissolved; bromide total; fluoride; fluoride dissolved; fluoride total; iodide; silica; silica dissolved; silica total; selenium; selenium total;
        nitrate; nitrite; nitrate nitrite; total dissolved solids; solides totaux; total solids; specific conductance; turbidity; alkalinity; gallium; barium; barium total; lithium; strontium;
        chromium; chromium total; chromium dissolved; scandium; rubidium; phosphate; phosphate total; ammonia; calcite; magnesite; salinity; conductivity; acidite totale""",
    "fraction": "supernatant; supernatant layer; sediment; bed sediment; pore water; tissue; composite; grab; replicate; field blank; blank; see note; settled; volatile; extractable",
}

WATER = Terms(_ABBREVIATIONS, frozenset(_NOISE), frozenset({"lab", "field"}), _OTHERS)
