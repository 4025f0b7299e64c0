"""A seed vocabulary of engineering terms, written from published standards' names.

Rows are ``library, canonical, family, forms``. The tables are starting points:
every operator takes a vocabulary of the same shape instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plansift.functions.text import as_re2

#: library: family: canonical form and other forms, between bars; the first is canonical.
SEED: dict[str, dict[str, list[str]]] = {
    "din8580": {
        "primary shaping": ["casting|cast", "sintering|sintered", "moulding|molding"],
        "forming": ["bending|bent|bend", "rolling|rolled", "forging|forged", "deep drawing|deep drawn", "pressing|pressed"],
        "cutting": ["turning|turned", "milling|milled", "drilling|drilled", "grinding|ground", "sawing|sawn", "laser cutting|laser cut", "deburring|deburred"],
        "joining": ["welding|welded|weld", "brazing|brazed", "soldering|soldered", "riveting|riveted", "bonding|bonded", "screwing|screwed"],
        "coating": ["painting|painted", "galvanizing|galvanized|galvanised|hot dip galvanized", "anodizing|anodized|anodised", "powder coating|powder coated", "phosphating|phosphated"],
        "changing properties": ["hardening|hardened", "annealing|annealed", "tempering|tempered", "blasting|blasted|shot blasted"],
    },
    "iso4063": {"arc": ["111|manual metal arc welding|mma", "135|mag welding|mag", "131|mig welding|mig", "141|tig welding|tig", "121|submerged arc welding|saw welding"], "resistance": ["21|spot welding", "22|seam welding", "23|projection welding"], "other": ["311|oxyacetylene welding", "51|electron beam welding", "52|laser beam welding"]},
    "assembly": {"mount": ["assemble|assembled|assembly instruction", "mount|mounted", "install|installed"], "fasten": ["tighten|tightened|tightening torque", "bolt|bolted", "lock|locked|secured"], "fit": ["press-fit|press fitted", "align|aligned"]},
    "fasteners": {"screw": ["ISO 4014|ISO4014", "ISO 4017|ISO4017", "ISO 4762|ISO4762|DIN 912|DIN912"], "nut": ["ISO 4032|ISO4032|DIN 934|DIN934"], "washer": ["ISO 7089|ISO7089|DIN 125|DIN125"]},
    "materials": {"steel": ["S235JR|S235", "S275JR|S275", "S355J2|S355", "C45|C45E"], "stainless": ["1.4301|AISI 304|X5CrNi18-10", "1.4404|AISI 316L"], "aluminium": ["EN AW-6082|AW6082", "EN AW-5754|AW5754"], "plastic": ["POM|polyoxymethylene", "PA6|polyamide 6", "PTFE"], "cast iron": ["EN-GJL-250|GJL250", "EN-GJS-400|GJS400"]},
    "bearings": {"deep groove": ["deep groove ball bearing|deep-groove ball bearing"], "roller": ["cylindrical roller bearing", "tapered roller bearing", "spherical roller bearing"], "other": ["needle bearing", "thrust bearing"]},
    "fits": {"clearance": ["H7/g6", "H8/f7"], "transition": ["H7/k6", "H7/n6"], "interference": ["H7/p6", "H7/s6"]},
    "gdt": {"form": ["flatness", "straightness", "circularity|roundness", "cylindricity"], "orientation": ["parallelism", "perpendicularity", "angularity"], "location": ["position tolerance", "concentricity", "symmetry"], "run-out": ["circular run-out|circular runout", "total run-out|total runout"]},
    "surface_texture": {"roughness": ["Ra", "Rz", "Rmax|Rz1max"], "lay": ["lay direction"]},
    "weld_quality": {"level": ["ISO 5817-B|quality level B", "ISO 5817-C|quality level C", "ISO 5817-D|quality level D"], "execution": ["EXC1|execution class 1", "EXC2|execution class 2", "EXC3|execution class 3"]},
    "crane_standards": {"standard": ["FEM 1.001", "ISO 4301", "EN 13001"]},
    "electrical_standards": {"protection": ["IP54", "IP55", "IP65", "IP66"], "efficiency": ["IE2", "IE3", "IE4"], "mounting": ["IM B3|B3 mounting", "IM B5|B5 mounting"]},
    "corrosion": {"category": ["corrosivity C3|C3 corrosivity", "corrosivity C4|C4 corrosivity", "corrosivity C5|C5 corrosivity"], "coating": ["zinc plated|zinc-plated", "primer", "top coat|topcoat"]},
    "production_lines": {"line": ["cutting line", "welding line", "painting line", "machining line", "assembly line"]},
}
#: Libraries whose tags count under another category.
FOLDED = {"corrosion": "surface", "surface_texture": "surface"}
#: Libraries whose forms are also known without blanks.
SPACE_FREE = ("fasteners", "bearings")


def forms(seed: dict[str, dict[str, list[str]]] | None = None) -> list[tuple[str, str, str, str]]:
    """``form, library, canonical, family`` in upper case; of one form within a library the first row wins."""
    out: dict[tuple[str, str], tuple[str, str, str, str]] = {}
    for library, families in (seed or SEED).items():
        for family, entries in families.items():
            for entry in entries:
                own = entry.split("|")
                for form in own:
                    for f in (form, form.replace(" ", "")) if library in SPACE_FREE else (form,):
                        out.setdefault((library, f.upper().strip()), (f.upper().strip(), library, own[0], family))
    return list(out.values())


def vocabulary(spark: SparkSession, seed: dict[str, dict[str, list[str]]] | None = None) -> DataFrame:
    """The vocabulary as a table ``form, library, canonical, family, category, n_words``."""
    rows = [(*r, FOLDED.get(r[1], r[1]), len(r[0].split())) for r in forms(seed)]
    return spark.createDataFrame(rows, "form string, library string, canonical string, family string, category string, n_words int")


# Structured codes, each anchored so that bare short codes do not match.
CODES: dict[str, str] = {
    "metric_thread": r"\bM\d{1,3}(?:x\d+(?:[.,]\d+)?)?\b",
    "pipe_thread": r"\bG ?\d/\d\b",
    "strength_grade": r"(?i)(?:grade|class|quality)\s+(?:4\.6|5\.6|8\.8|10\.9|12\.9)\b",
    "steel_grade": r"\bS(?:235|275|355|420|460)[A-Z0-9+]*\b",
    "material_number": r"\b1\.[0-9]{4}\b",
    "tolerance_class": r"(?i)\bISO\s?2768-?\s?[mfcv][KLH]?\b",
    "fit_pair": r"\b[A-H]\d{1,2}/[a-z]{1,2}\d{1,2}\b",
    "it_grade": r"\bIT(?:1[0-8]|[1-9])\b",
    "roughness": r"\bR[az]\s?\d+(?:[.,]\d+)?\b",
    "roughness_number": r"\bN(?:1[0-2]|[1-9])\b",
    "weld_quality": r"(?i)\bISO\s?5817[- ]?[BCD]\b",
    "protection": r"\bIP\s?[0-6][0-9]\b",
    "efficiency": r"\bIE[1-5]\b",
    "corrosivity": r"(?i)\bcorrosivity\s+C[1-5][MIX]?\b",
    "coating_thickness": r"\b\d{2,4}\s?(?:µm|um)\b",
    "ball_bearing": r"\b6[0-4]\d{2}(?:-?(?:2RS1?|2Z|ZZ|RS|Z))\b",
    "roller_bearing": r"\b(?:N[UJP]P?|NN|QJ|HK|NK[IS]?)\s?\d{2,5}\b",
    "spherical_bearing": r"\b2[23][0-9]\d{2}\s?(?:CC|E|CA|MB)\b",
    "aluminium_alloy": r"(?i)\bEN\s?AW-?\s?\d{4}\b",
    "cast_iron": r"\b(?:EN-)?GJ[LSM]-?\d{3}\b",
    "plastic": r"\b(?:POM(?:-[CH])?|PA\s?(?:6|66|12)|PTFE|PE-?(?:HD|UHMW)|PEEK)\b",
    "crane_group": r"(?i)\bFEM\s?(?:1A[mM]|1[BC]m|[1-5]m)\b",
    "mounting": r"\bIM\s?[BV]\s?\d{1,2}\b",
    "duty": r"\bduty\s+S(?:10|[1-9])\b",
    "paint_system": r"(?i)\bISO\s?12944-?\d?/?\s?C[1-5](?:-?[MIX])?\b",
    "zinc_coating": r"\b(?:Fe/Zn|DX5\d?D?\+Z)\s?\d{1,3}\b",
}


def code_hits(text: str, names: list[str] | None = None) -> list:
    """A column ``n_<name>`` for each code: how often it stands in the text column."""
    return [F.regexp_count(F.col(text), F.lit(as_re2(CODES[n]))).alias(f"n_{n}") for n in names or CODES]


# Roughness numbers and their Ra in micrometres; each is twice the one before.
N_TO_RA = {f"N{n}": 0.025 * 2 ** (n - 1) for n in range(1, 9)} | {"N9": 6.3, "N10": 12.5, "N11": 25.0, "N12": 50.0}


def ra_of(number):
    """The Ra of a roughness number, null if there is none."""
    table = F.create_map(*[x for k, v in N_TO_RA.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(table, F.upper(number))


def bore_of(code):
    """The bore in millimetres of a bearing's two-digit code."""
    n = code.try_cast("int")
    return F.when(code == "00", 10).when(code == "01", 12).when(code == "02", 15).when(code == "03", 17).when(n.between(4, 96), n * 5)


def fit_kind(hole_shaft):
    """Clearance, transition or interference of a hole-basis fit, by the shaft's letter."""
    letter = F.lower(F.regexp_extract(hole_shaft, r"/([a-zA-Z]{1,2})\d", 1))
    return F.when(letter == "", None).when(letter < "i", "clearance").when(letter < "o", "transition").otherwise("interference")
